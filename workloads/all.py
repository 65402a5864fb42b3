"""Importing this module registers every workload."""

from workloads import digests, discovery, documents, flows, guidelines, tables, vectors, works  # noqa: F401
