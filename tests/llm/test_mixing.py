import collections
import hashlib
import re

import pytest

from paperlake.llm import mixing as M
from tests.llm.conftest import MIDDLE


def fit_by_hand(cells, temper, rounds=200):
    """The same fitting in plain Python: {cell: weight}."""
    total = sum(cells.values())
    x = {c: m / total for c, m in cells.items()}
    aims = []
    for d in range(3):
        sums = collections.Counter()
        for c, m in cells.items():
            sums[c[d]] += m
        raw = {k: (v / total) ** temper for k, v in sums.items()}
        aims.append({k: v / sum(raw.values()) for k, v in raw.items()})
    for _ in range(rounds):
        for d in range(3):
            sums = collections.Counter()
            for c, v in x.items():
                sums[c[d]] += v
            x = {c: v * aims[d][c[d]] / sums[c[d]] for c, v in x.items()}
    return {c: x[c] * total / m for c, m in cells.items()}, x, aims


def test_against_plain_python(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    got = M.mix_sources(docs, keep_share=0.7, temper=0.5).collect()
    cells, tokens = collections.Counter(), 0
    for r in got:
        assert r.n_tokens == len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        low = r.text.lower()
        hits = {t: sum(w in low for w in ws) for t, ws in M.TOPICS.items()}
        assert r.topic == (max(hits, key=hits.get) if max(hits.values()) else "general")
        cells[(r.source, r.lang, r.topic)] += r.n_tokens
        tokens += r.n_tokens
    weights, _, _ = fit_by_hand(cells, 0.5)
    expected = 0.0
    for r in got:
        assert r.weight == pytest.approx(weights[(r.source, r.lang, r.topic)], rel=1e-5)
        u = int(hashlib.md5(f"{r.doc_id}/1".encode()).hexdigest()[:8], 16) / 2**32
        assert r.sampled == (u < r.probability)
        expected += r.probability * r.n_tokens
    assert expected == pytest.approx(0.7 * tokens, rel=1e-6)
    assert sum(r.sampled * r.n_tokens for r in got) == pytest.approx(0.7 * tokens, rel=0.1)


def test_given_targets_are_met(spark):
    rows = [(k, "word " * (k % 7 + 1), "ab"[k % 2], "xyz"[k % 3]) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = {"source": {"a": 0.7, "b": 0.3, "absent": 5.0}, "lang": {"x": 1, "y": 1, "z": 2}}
    got = M.mix_sources(df, targets=targets, topics={}, keep_share=0.5).collect()
    sums, total = collections.Counter(), 0.0
    for r in got:
        for key in (r.source, r.lang):
            sums[key] += r.n_tokens * r.weight
        total += r.n_tokens * r.weight
    shares = {k: v / total for k, v in sums.items()}
    assert shares == pytest.approx({"a": 0.7, "b": 0.3, "x": 0.25, "y": 0.25, "z": 0.5}, abs=1e-6)


def test_nulls_repeats_clashes_and_empty_table(spark):
    rows = [(1, None, None, None, "w"), (2, "", "s", "l", "w"), (3, "a b", "s", None, "w"), (3, "a b", "s", None, "w"), (None, "c", None, "l", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, weight string")
    got = M.mix_sources(df, keep_share=1.0).collect()
    assert len(got) == 5 and all(r.probability <= 1 and r.sampled is not None for r in got)
    assert sorted(r.n_tokens for r in got) == [0, 0, 1, 2, 2]
    assert len({(r.sampled, r.weight) for r in got if r.doc_id == 3}) == 1
    assert got[0].asDict().keys() == {"doc_id", "text", "source", "lang", "topic", "n_tokens", "weight", "probability", "sampled"}
    assert M.mix_sources(df.limit(0)).count() == 0
    only_empty = M.mix_sources(df.where("doc_id <= 2"), keep_share=0.5).collect()
    assert [r.weight for r in only_empty] == [1.0, 1.0]


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    plan = M.mix_sources(docs, rounds=1)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_hot_categories_are_summed_in_the_tasks(spark):
    """No window over a category: 3,000 sources share two topics."""
    cells = spark.range(6000).selectExpr("concat('s', id div 2) source", "'x' lang", "concat('t', id % 2) topic", "1.0 + id % 7 mass")
    raked = M.rake(cells, rounds=2)
    assert "Window" not in raked._jdf.queryExecution().toString()
    sums = {r.topic: r.m for r in raked.groupBy("topic").agg(M.F.sum(M.F.col("mass") * M.F.col("weight")).alias("m")).collect()}
    assert sum(sums.values()) == pytest.approx(24_000, rel=0.01)


def test_targets_that_cannot_be_met_are_told(spark):
    rows = [("a", "x", "t", 10.0), ("b", "y", "t", 10.0)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, mass double")
    with pytest.warns(RuntimeWarning, match="off their targets"):
        M.rake(cells, targets={"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}}, rounds=3)
