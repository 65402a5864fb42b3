import collections
import random
import re

import numpy as np
import pytest

from paperlake.llm import collocations as C
from paperlake.llm import quotient_filter as Q

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def keys(seed, n, bits):
    r = np.random.default_rng(seed)
    draw = lambda b: r.integers(0, 2**b, n, dtype=np.uint64, endpoint=False)
    return draw(2 * bits) if bits < 32 else r.integers(0, 2**64, n, dtype=np.uint64), draw(bits)


@pytest.mark.parametrize("bits", [1, 2, 5, 17, 21, 31, 32])
def test_permutation_is_invertible(bits):
    left, right = keys(bits, 5000, bits)
    a, b = Q.permute(left, right, bits)
    assert a.max() <= 2 ** (2 * bits) - 1 and b.max() <= 2**bits - 1
    x, y = Q.restore(a, b, bits)
    assert (x == left).all() and (y == right).all()
    if bits == 2:
        every = np.arange(64, dtype=np.uint64)
        a, b = Q.permute(every >> np.uint64(2), every & np.uint64(3), 2)
        assert len(set(zip(a.tolist(), b.tolist()))) == 64


@pytest.mark.parametrize("bits,n,fixed", [(1, 4, 0), (3, 60, 2), (17, 9000, 3), (21, 1, 5), (32, 5000, 4), (32, 700, 0)])
def test_filters_are_lossless(bits, n, fixed):
    left, right = keys(n, n, bits)
    counts = np.random.default_rng(1).integers(1, 600, n)
    left, right, counts = Q.counted(left, right, counts)
    for prefix in range(1 << fixed):
        mine = (left >> np.uint64(2 * bits - fixed)) == prefix if fixed else np.ones(len(left), bool)
        if mine.any():
            data = Q.pack(left[mine], right[mine], counts[mine], bits, fixed)
            back = Q.unpack(data, prefix)
            assert all((x == y[mine]).all() for x, y in zip(back, (left, right, counts)))
    if n == 9000:
        assert len(Q.pack(left, right, np.minimum(counts, 254), bits, 0)) < 8 * len(left)


def test_merging_adds_counts():
    left, right = (np.array(x, dtype=np.uint64) for x in ([5, 5, 1, 5, 1], [2, 1, 0, 2, 0]))
    found = Q.counted(left, right, np.array([300, 1, 2, 5, 9]))
    assert [x.tolist() for x in found] == [[1, 5, 5], [0, 1, 2], [11, 1, 305]]


def brute(rows, least, covered, top=None):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    out = {}
    found = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    for (lang, *w), a in found.items():
        if len(w) == 2 and any(
            100 * b >= covered * a for (other, *v), b in found.items() if other == lang and len(v) == 3 and w in (v[:2], v[1:])
        ):
            continue
        cuts = [(10**6 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    return sorted(
        (lang, rank, p.decode(), -a, l, r, n[lang], -s)
        for lang, some in out.items()
        for rank, (s, a, p, l, r) in enumerate(sorted(some)[:top], start=1)
    )


def texts(seed, many=300):
    r = random.Random(seed)
    vocabulary = ["le", "la", "new", "York", "big", "äpfel", "%%", "x-1", "new york", "\U0001f600"] + [f"w{k}" for k in range(30)]
    rows = []
    for _ in range(many):
        w = [r.choice(vocabulary) for _ in range(r.randrange(1, 40))]
        if r.random() < 0.5:
            at = r.randrange(len(w))
            w[at:at] = r.choice((["New", "York", "city"], ["ad", "hoc"], ["le", "le", "le", "le"]))
        rows.append(("".join(x + r.choice((" ", " ", " ", "\t", " \n", ". ", ",", "\x0b", "  ")) for x in w), r.choice(("en", "en", "fr", None))))
    return rows + [("", "en"), (None, "fr"), (None, None), (" .,; ", "de"), ("only words here", "de")] + [rows[0]] * 40


def result(frame):
    assert frame.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("least,covered,shard_bytes,parts", [(10, 50, C.SHARD_BYTES, 1), (10, 50, 300, 4), (2, 80, 2000, 3)])
def test_phrases_against_counting_by_hand(spark, least, covered, shard_bytes, parts):
    rows = texts(least + parts)
    df = spark.createDataFrame(rows, "text string, lang string").withColumn("phrase", C.F.lit("clash")).repartition(parts)
    found = result(C.phrases(df, least=least, covered=covered, shard_bytes=shard_bytes))
    assert found == brute(rows, least, covered) and len(found) > 5


def test_first_phrases_of_each_language(spark):
    rows = texts(8)
    df = spark.createDataFrame(rows, "text string, lang string")
    assert result(C.phrases(df, top=3)) == brute(rows, 10, 50, 3)


def test_nothing_to_find(spark):
    for rows in ([], [(None, None)], [("a b c. d", "en")] * 9, [("word", "en")] * 30):
        assert result(C.phrases(spark.createDataFrame(rows, "text string, lang string"))) == []


def test_a_very_long_text_and_a_very_frequent_word(spark):
    rows = [("the the " * 60_000, "en"), ("a rare pair " * 12, "en")]
    assert result(C.phrases(spark.createDataFrame(rows, "text string, lang string"))) == brute(rows, 10, 50)


def test_scores_beyond_64_bits(spark):
    big = 9 * 10**14
    df = spark.createDataFrame([(big, big + 1, big + 7)], "a long, l long, r long")
    assert df.select(C._score("a", "l", "r")).first()[0] == 10**6 * big * big // ((big + 1) * (big + 7))
