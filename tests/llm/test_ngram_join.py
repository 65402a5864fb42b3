import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from paperlake.llm import ngram_join as N
from paperlake.llm.queries import QUERIES
from tests.llm.conftest import MIDDLE

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=5):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) or frozenset([tuple(w)])


def components(docs, percent=80, width=5):
    """Every pair is compared."""
    sets = {d: shingles(t, width) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = collections.defaultdict(list)
    for d, s in sorted(sets.items()):
        shared = collections.Counter(o for g in s for o in where[g])
        for o, k in shared.items():
            if 100 * k >= percent * (len(s) + len(sets[o]) - k):
                a, b = sorted((find(d), find(o)))
                parent[b] = a
        for g in s:
            where[g].append(d)
    return {d: (len(sets[d]), find(d)) for d in sets}


def result(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


def test_query_over_the_whole_table(spark, documents):
    assert result(QUERIES["op3_ngram_join"](spark, MIDDLE)) == components(documents)


def families(seed):
    """Copies with a few words changed, around bases of different lengths, and texts that share a passage."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    passage = [word() for _ in range(40)]
    docs = []
    for n in (6, 12, 40, 150, 150):
        base = [word() for _ in range(n)]
        docs.append(base)
        for _ in range(25):
            copy = list(base)
            for _ in range(r.choice((0, 1, 1, 2, 3, 4, 6))):
                copy[r.randrange(len(copy))] = word()
            docs.append(copy[: r.choice((len(copy), len(copy), len(copy) - 3))])
    chain = [word() for _ in range(120)]
    for k in range(12):  # neighbours are similar, the ends are not
        docs.append(chain[4 * k :] + [word() for _ in range(4 * k)])
    docs += [passage + [word() for _ in range(r.choice((3, 8, 30, 120)))] for _ in range(40)]
    docs += [passage, passage[:39], passage[:4], passage[:4], ["one"], ["one"], []]
    r.shuffle(docs)
    return [(3 * k + 1, " ".join(d)) for k, d in enumerate(docs)]


@pytest.mark.parametrize("seed,block", [(1, 500_000), (2, 60)])
def test_families_against_all_pairs(spark, seed, block):
    docs = families(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert result(N.near_duplicates(df, block=block)) == components(docs)


@pytest.mark.parametrize("percent,width", [(60, 3), (100, 2), (91, 1)])
def test_other_parameters(spark, percent, width):
    docs = families(5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert result(N.near_duplicates(df, percent=percent, width=width)) == components(docs, percent, width)


def test_bounds_are_exact():
    for percent in (50, 80, 93):
        for a in range(1, 60):
            for b in range(1, 60):
                least = next(k for k in range(0, a + b + 1) if 100 * k >= percent * (a + b - k))
                assert N.least_overlap(a, b, percent) == least
            assert N.prefix_length(a, percent) == a - -(-percent * a // 100) + 1


def test_nulls_repeats_case_and_extra_columns(spark):
    long = " ".join(f"w{k}" for k in range(30))
    rows = [(1, None, 1), (2, "", 2), (3, "  \n", 3), (4, long, 4), (4, long, 4), (9, long.upper(), 5), (None, long, 6), (None, None, 7), (5, "É é", 8), (6, "é é", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id long")
    got = sorted(map(tuple, N.near_duplicates(df).collect()), key=str)
    assert got == sorted(
        [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 26, 4), (4, 26, 4), (9, 26, 4), (None, 26, None), (None, 0, None), (5, 1, 5), (6, 1, 6)], key=str
    )
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_candidates_of_a_large_family_grow_linearly():
    """A block of one family: members meet the hub, not one another."""
    import pyarrow as pa

    n = 3000
    tokens, ids = np.full(n, 7, dtype=np.uint64), np.arange(n)
    column = {"tokens": tokens, "ids": ids, "sizes": np.full(n, 100, "<u4"), "places": np.minimum(np.arange(n), 5).astype("<u4"),
              "ends": np.zeros(n, np.float32), "spread": np.zeros(n, np.uint8), "runs": np.ones(n, "<u4")}
    table = pa.table({name: pa.array([x.tobytes()], pa.binary()) for name, x in column.items()})
    found = N._block_product(80)(table)
    assert found.num_rows - found.column("b").null_count == n - 1


def test_first_entries_shared_beyond_those_of_the_other_row(spark):
    """Two similar rows meet in long columns with another hub only, and the first entries of one end later."""
    r = random.Random(3)
    words = lambda n: ["".join(r.choices("abcdefghij", k=8)) for _ in range(n)]
    passage, body, other = words(9), words(99), words(99)
    docs = [passage + words(1) + other for _ in range(6)]
    docs += [passage + words(1) + body, passage + words(1) + body + words(14)]
    docs += [body + other + words(1200) for _ in range(12)]  # make both bodies frequent
    docs = [(k, " ".join(d)) for k, d in enumerate(docs, start=1)]
    wanted = components(docs)
    assert wanted[8] == (119, 7)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert result(N.near_duplicates(df)) == wanted


def test_many_dissimilar_rows_share_a_passage(spark):
    """No pair of them is similar, so none may be left for the last join; the few similar ones are found."""
    r = random.Random(11)
    words = lambda n: ["".join(r.choices("abcdefghij", k=8)) for _ in range(n)]
    passage = words(60)
    docs = [words(5) + passage + words(25) for _ in range(300)]
    docs += [docs[0][:88] + words(2), docs[1][:87] + words(3), docs[1][3:]]
    docs = [(k, " ".join(d)) for k, d in enumerate(docs)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert result(N.near_duplicates(df)) == components(docs)


def test_one_id_with_different_texts(spark):
    r = random.Random(5)
    words = lambda n: ["".join(r.choices("abcdefghij", k=8)) for _ in range(n)]
    one, two = words(50), words(50)
    docs = [(1, one), (2, one[:49]), (2, two), (3, two[1:]), (3, two[1:]), (4, words(7))]
    df = spark.createDataFrame([(k, " ".join(d)) for k, d in docs], "doc_id long, text string")
    for parts in (1, 5):
        rows = N.near_duplicates(df.repartition(parts)).collect()
        assert sorted((x.doc_id, x.n_shingles) for x in rows) == [(1, 46), (2, 45), (2, 46), (3, 45), (3, 45), (4, 3)]
        of = {x.doc_id: x.component_id for x in rows}
        assert of[4] == 4 and (of[1], of[2], of[3]) in ((1, 1, 3), (1, 2, 2))
        assert len({(x.doc_id, x.component_id) for x in rows}) == 4


def test_numbers_are_sent_by_bytes_of_a_place():
    for kind in (np.uint64, np.int64, "<u4", np.float32, np.uint8):
        parts = [np.arange(n, dtype=kind) * 3 for n in (5, 1, 70_000)]
        sent = [N._planes(p[::2]) for p in parts]
        assert np.array_equal(N._from_planes(sent, kind), np.concatenate([p[::2] for p in parts]))
    ids = 10**9 + np.sort(np.random.default_rng(1).choice(10**5, 20_000, replace=False))
    packed = lambda b: pa.compress(b, codec="lz4_raw", asbytes=True)
    assert 2 * len(packed(N._planes(ids))) < len(packed(ids.tobytes()))
