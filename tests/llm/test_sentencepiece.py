import struct

import public_tokenizers
import pytest
import sentencepiece

from paperlake.llm import sentencepiece_model as S
from paperlake.llm import token_counts
from paperlake.llm.queries import QUERIES
from paperlake.llm.token_counts import count_tokens
from tests.llm.conftest import MIDDLE

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "   a", "a   ", "hello  world\n\nfoo <s> </s> <unk> <0x0A> \t x ﬁ é", " hello ", "\n", "\n\na", "a\n b", "▁▁x ▁",
    "\0a", "日本 語 🎉", "   \n  b", "x" * 3000, "ab " * 2000, "\u00a0 \u2003", "a\r\nb",
]


@pytest.fixture(scope="module")
def data():
    with open(PATH, "rb") as file:
        return file.read()


def test_parity_with_the_library():
    assert all(S.parity(PATH, ODD))


def test_segments_give_the_same_ids_as_whole_texts(data):
    encoder, whole = S.Encoder(data, cached=50, verify=True), S.build_tokenizer(data)
    for _ in range(2):  # the cache is emptied in between
        packed, agreed = encoder.encode(ODD)
        assert agreed == [True] * len(ODD)
        assert [list(struct.unpack(f"{len(p) // 4}i", p)) for p in packed] == [e.ids for e in whole.encode_batch(ODD)]


def test_query_over_the_whole_table(spark, documents):
    rows = QUERIES["op2_sentencepiece"](spark, MIDDLE).collect()
    processor = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = dict(documents)
    assert len(rows) == len(documents)
    for r in rows:
        assert r.parity and r.round_trip and r.n_tokens == len(r.ids) and r.ids == processor.encode(texts[r.doc_id])


def test_decoder_matches_the_library(data):
    import numpy as np

    processor = sentencepiece.SentencePieceProcessor(model_file=PATH)
    lists = [processor.encode(t) for t in ODD] + [[3 + 0xE6], [3 + 0x80, 300], [1, 400, 2], [0], []]
    ids = np.array([i for some in lists for i in some], dtype=np.int32)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    library = S.build_tokenizer(data).decode_batch(lists, skip_special_tokens=False)
    assert S.Decoder(data).decode(ids, offsets).to_pylist() == library
    good = [k for k in range(len(ODD))]
    offsets = offsets[: len(good) + 1]
    assert S.Decoder(data).decode(ids[: offsets[-1]], offsets).to_pylist() == ODD[:10] + [ODD[10].replace("▁", " ")] + ODD[11:]


def _unigram(pieces):
    """A unigram model file written field by field."""

    def field(number, wire, payload):
        key = bytes([number << 3 | wire]) if number < 16 else bytes([(number << 3 | wire) & 127 | 128, number >> 4])
        return key + (bytes([len(payload)]) + payload if wire == 2 else payload)

    out = b""
    for text, score, kind in pieces:
        out += field(1, 2, field(1, 2, text.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind])))
    trainer = field(3, 0, b"\1") + field(35, 0, b"\1")
    normalizer = field(1, 2, b"identity") + field(3, 0, b"\1") + field(4, 0, b"\1") + field(5, 0, b"\1")
    return out + field(2, 2, trainer) + field(3, 2, normalizer)


def test_unigram_scores_are_rebuilt(tmp_path):
    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)]
    pieces += [(f"<0x{k:02X}>", -20, 6) for k in range(256)]
    words = ["▁", "▁a", "a", "b", "ab", "▁ab", "abc", "c", "bc", "▁b", "cab", "s", "<"]
    pieces += [(w, -1.0 - 0.37 * k, 1) for k, w in enumerate(words)]
    path = tmp_path / "unigram.model"
    path.write_bytes(_unigram(pieces))
    texts = ["a", "abc cab", "  ab   c ", "abcabcabc", "bca é x", "", "<s> a"]
    assert S.parse_model(path.read_bytes()).model_type == S.UNIGRAM
    assert all(S.parity(str(path), texts))


def test_nulls_repeats_clashes_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "a b", "z"), (3, "a b", "z")], "doc_id long, text string, ids string")
    rows = {r.doc_id: r for r in S.encode(df, PATH, parity_col="parity").collect()}
    assert rows[1].ids is None and rows[1].parity is None and rows[2].ids == [] and rows[3].parity
    back = S.decode(S.encode(df, PATH), PATH)
    assert sorted((r.doc_id, r.decoded) for r in back.collect() if r.doc_id != 1) == [(2, ""), (3, "a b"), (3, "a b")]
    assert [r.decoded for r in back.where("doc_id = 1").collect()] == [None]
    assert S.encode(df.limit(0), PATH).count() == 0


def test_token_counts(spark, documents):
    processor = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = QUERIES["op8_token_counts"](spark, MIDDLE).collect()
    texts = dict(documents)
    assert len(rows) == len(documents)
    for r in rows:
        n = len(processor.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)


@pytest.mark.parametrize("bits", [4, 12])
def test_token_counts_of_odd_texts(spark, bits):
    processor = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [(k, t, "x") for k, t in enumerate([*ODD, None, *ODD])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    for r in count_tokens(df, PATH, limit=10, table_bits=bits).collect():
        t = rows[r.doc_id][1] or ""
        n = len(processor.encode(t))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 10)
    assert count_tokens(df.limit(0), PATH).count() == 0


def test_tier_one_holds_what_is_frequent_in_all_rows(spark):
    """Words of the last rows of an ordered table are in the table, though each task may report few."""
    common = [f"late{k}" for k in range(40)]
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(60))) for k in range(400)] + [(k, " ".join(common)) for k in range(400, 480)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = token_counts._summaries(df, "text", 100).collect()
    assert len(found) <= 100 and {f" {w}".encode() for w in common} <= {bytes(r.text) for r in found}
    keys, lengths = token_counts._frequent(df, PATH, "text", 8, 100)
    assert 0 < (lengths > 0).sum() <= 128
    processor = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = {r.doc_id: r.n_tokens for r in count_tokens(df, PATH, table_bits=8, summary=100).collect()}
    assert all(got[k] == len(processor.encode(t)) for k, t in rows)
