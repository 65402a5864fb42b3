"""Find the records that are the same work, and label each record with its work.

Records link when they share a DOI, PMID or PMCID, when their normalised titles
are equal, or when the titles are similar: token Jaccard and sequence ratio both
at least the threshold. Works are the connected components of those links.
Links are star edges to the first record of a key, never pairs within a group.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.functions.rows import explode_once
from paperlake.functions.text import blank_to_null, canonical_doi, identity_key, normalize_title
from paperlake.session import cut_lineage

# Titles up to this many distinct tokens meet on deletion keys; see _deletion_keys.
SHORT_TITLE = 28


def _identity_keys(articles: DataFrame, canonical: bool, titles: bool) -> DataFrame:
    doi = canonical_doi(F.col("doi")) if canonical else identity_key(F.col("doi"))
    keys = [("doi", doi), ("pmid", F.col("pmid")), ("pmcid", identity_key(F.col("pmcid")))]
    if titles:
        keys.append(("title", normalize_title(F.col("title"))))
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), blank_to_null(v).alias("key")) for k, v in keys])
    return articles.select("seq", F.explode(pairs).alias("k")).select("seq", "k.kind", "k.key").where(
        F.col("key").isNotNull()
    )


def identity_edges(articles: DataFrame, canonical_doi: bool = True, titles: bool = True) -> DataFrame:
    """Edges (src, dst, kind) from the first record of each DOI, PMID, PMCID and normalised title to the others."""
    keys = _identity_keys(articles, canonical_doi, titles)
    first = keys.groupBy("kind", "key").agg(F.min("seq").alias("src"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keys.join(first, ["kind", "key"]).where("seq <> src").select("src", F.col("seq").alias("dst"), "kind")


def sequence_ratio(a: str, b: str, threshold: float) -> bool:
    matcher = SequenceMatcher(None, a, b)
    return (
        matcher.real_quick_ratio() >= threshold
        and matcher.quick_ratio() >= threshold
        and matcher.ratio() >= threshold
    )


def _ratio_udf(threshold: float):
    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([sequence_ratio(x, y, threshold) for x, y in zip(a, b)], dtype="bool")

    return similar


def _deletion_keys(titles: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(whole, one less, two less): keys of the token sets of short titles, and of those sets less a token or two.

    With threshold 0.9, two sets of at most 28 tokens each differ in at most
    two tokens. Then one set is the other plus a token or two, or each has one
    token of its own. So similar titles share a key, and titles that share
    fewer tokens do not, however much of a template they have in common.

    A key is the xor of token hashes: taking a token out is one more xor.
    """
    hashes = F.transform("tokens", lambda t: F.xxhash64(t))
    short = (
        titles.where(F.size("tokens") <= SHORT_TITLE)
        .select("id", F.size("tokens").alias("n"), hashes.alias("hs"))
        .withColumn("key", F.aggregate("hs", F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(h)))
    )
    n = F.col("n")
    whole = short.select("id", "n", "key")
    less_one = F.transform("hs", lambda h: F.col("key").bitwiseXOR(h))
    one = explode_once(short.where((n - 1) / n >= threshold - 1e-9).withColumn("whole", F.col("key")), less_one, "key")
    less_two = F.flatten(
        F.transform(
            "hs",
            lambda h, i: F.transform(
                F.slice("hs", i + 2, F.size("hs")), lambda g: F.col("key").bitwiseXOR(h).bitwiseXOR(g)
            ),
        )
    )
    two = explode_once(short.where((n - 2) / n >= threshold - 1e-9), less_two, "key")
    return whole, one.select("id", "n", "key"), two.select("id", "n", "key")


def _rare_token_keys(titles: DataFrame, threshold: float) -> DataFrame:
    """(id, n, key): the rarest tokens of long titles; two similar titles share one of them.

    Titles a little shorter take part, for their longer partners.
    """
    long = titles.withColumn("n", F.size("tokens")).where(F.col("n") >= int(SHORT_TITLE * threshold))
    tokens = long.select("id", "n", F.explode("tokens").alias("token"))
    frequency = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ordered = (
        tokens.join(frequency, "token")
        .groupBy("id", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("by_rarity"))
    )
    kept = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1
    return explode_once(ordered, F.slice("by_rarity", 1, kept), "p").select("id", "n", F.xxhash64("p.token").alias("key"))


def _plus_tokens(whole: DataFrame, shorter: DataFrame) -> DataFrame:
    """Pairs of a title and one with a token or two more."""
    longer = shorter.select(F.col("id").alias("other"), "key")
    return whole.join(longer, "key").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))


def _groups(titles: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(pairs of titles that differ by added tokens, (kind, key, id, n) memberships whose members may all be similar)."""
    whole, one, two = _deletion_keys(titles, threshold)
    pairs = _plus_tokens(whole, one).unionByName(_plus_tokens(whole, two))
    swapped = one.where((F.col("n") - 1) / (F.col("n") + 1) >= threshold - 1e-9)  # one token each of their own
    members = None
    for kind, keys in (("same", whole), ("swap", swapped), ("rare", _rare_token_keys(titles, threshold))):
        part = keys.select(F.lit(kind).alias("kind"), "key", "id", "n")
        members = part if members is None else members.unionByName(part)
    shared = members.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("hub")).where("c > 1")
    return pairs, members.join(shared.drop("c"), ["kind", "key"])


def _near_sizes(threshold: float):
    """Members of a rare-token group that can be similar, and have not met on deletion keys."""
    n, m = F.col("n"), F.col("m")
    sizes = F.least(n, m) >= F.greatest(n, m) * threshold - 1e-9
    return sizes & ((F.col("kind") != "rare") | (F.greatest(n, m) > SHORT_TITLE))


def _group_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    other = right.select("kind", "key", F.col("id").alias("other"), F.col("n").alias("m"))
    return (
        left.join(other, ["kind", "key"])
        .where(_near_sizes(threshold) & (F.col("id") != F.col("other")))
        .select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
        .distinct()
    )


def _with_jaccard(pairs: DataFrame, titles: DataFrame, threshold: float) -> DataFrame:
    left = titles.select(F.col("id").alias("a"), F.col("norm").alias("norm_a"), F.col("tokens").alias("tokens_a"))
    right = titles.select(F.col("id").alias("b"), F.col("norm").alias("norm_b"), F.col("tokens").alias("tokens_b"))
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .withColumn("jaccard", shared / (F.size("tokens_a") + F.size("tokens_b") - shared))
        .where(F.col("jaccard") >= threshold)
        .drop("tokens_a", "tokens_b")
    )


def distinct_titles(articles: DataFrame) -> DataFrame:
    """(id, norm, tokens) of each distinct normalised title; ``id`` is its first record."""
    # a filter on a plain column would go below it and normalise titles a second time
    normalized = explode_once(articles.select("seq", "title"), F.array(normalize_title(F.col("title"))), "norm")
    distinct = (
        normalized.where("norm <> ''")
        .groupBy("norm")
        .agg(F.min("seq").alias("id"))
        .withColumn("tokens", F.array_distinct(F.split("norm", " ")))
    )
    return cut_lineage(distinct)


def _check(threshold: float) -> None:
    if not 0.9 <= threshold <= 1.0:
        raise ValueError("threshold must lie between 0.9 and 1")


def title_candidates(titles: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b), a < b, of titles whose token sets may reach the Jaccard threshold; none that does is missed."""
    pairs, members = _groups(titles, threshold)
    return pairs.unionByName(_group_pairs(members, members, threshold)).distinct()


def jaccard_pairs(articles: DataFrame, threshold: float = 0.9) -> DataFrame:
    """All (a, b, norm_a, norm_b, jaccard) of distinct titles whose token sets reach the threshold, for review."""
    _check(threshold)
    titles = distinct_titles(articles)
    return _with_jaccard(title_candidates(titles, threshold), titles, threshold)


def title_edges(articles: DataFrame, threshold: float = 0.9, ratio: bool = True) -> DataFrame:
    """Edges (src, dst, kind) that join records whose titles are similar but not equal.

    In a group of titles that may all be similar, every title is compared with
    the first one. Those that are similar to it are joined through it, so pairs
    among them add nothing; only the others are compared with the whole group.
    The joined records are the same as with all similar pairs.

    The sequence ratio takes the earlier title first, and runs on pairs that
    passed the Jaccard test and whose lengths let it reach the threshold;
    ``ratio=False`` joins on the Jaccard test alone.
    """
    _check(threshold)
    titles = distinct_titles(articles)
    similar = _ratio_udf(threshold)

    def verified(pairs: DataFrame) -> DataFrame:
        passed = _with_jaccard(pairs, titles, threshold)
        if ratio:
            shorter = F.least(F.length("norm_a"), F.length("norm_b"))
            near = 2 * shorter >= threshold * (F.length("norm_a") + F.length("norm_b"))
            passed = passed.where(near).where(similar("norm_a", "norm_b"))
        return passed.select(F.col("a").alias("src"), F.col("b").alias("dst"))

    pairs, members = _groups(titles, threshold)
    members = cut_lineage(members)
    hubs = members.where("id = hub")
    to_hub = cut_lineage(verified(_group_pairs(members, hubs, threshold)))
    joined = to_hub.select(F.col("src").alias("hub"), F.col("dst").alias("id"))
    rest = members.where("id <> hub").join(joined, ["hub", "id"], "left_anti")
    among = verified(_group_pairs(rest, members.where("id <> hub"), threshold))
    added = verified(pairs.distinct())
    return to_hub.unionByName(among).unionByName(added).distinct().withColumn("kind", F.lit("similar_title"))


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node with an edge; the component is its smallest node.

    Alternating large-star and small-star rounds: a logarithmic number of them
    even for long chains. A round is an aggregate (combined before the shuffle)
    and a join with one row per node, so a hub node does not collect its edges.
    """

    def minimum(links: DataFrame) -> DataFrame:
        return links.groupBy("u").agg(F.min("v").alias("m"))

    links = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v")
    links = cut_lineage(links.distinct())
    seen = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = minimum(both).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = minimum(large)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut_lineage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    roots = links.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def resolve_works(
    articles: DataFrame, threshold: float = 0.9, fuzzy: bool = True, canonical_doi: bool = True, ratio: bool = True
) -> DataFrame:
    """``articles`` with ``work_id``: the smallest ``seq`` of the records that are the same work.

    ``ratio=False`` takes similar titles by their tokens alone.
    """
    edges = identity_edges(articles, canonical_doi).select("src", "dst")
    if fuzzy:
        edges = edges.unionByName(title_edges(articles, threshold, ratio).select("src", "dst"))
    components = connected_components(edges)
    return (
        articles.join(components.withColumnRenamed("node", "seq"), "seq", "left")
        .withColumn("work_id", F.coalesce("component", "seq"))
        .drop("component")
    )
