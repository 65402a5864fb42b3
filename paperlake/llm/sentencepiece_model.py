"""A SentencePiece model file rebuilt for the tokenizers library (operator 2).

The protobuf is read field by field. From it come the normaliser, the metaspace
marker, the pieces with their scores (unigram) or their merges (BPE), and byte
fallback. ``parity`` compares the result with the sentencepiece library itself.
Under a unigram model a text that spells a byte piece (``<0x0A>``) may get it.

Defined results: a null text has no ids (null) and decodes to null; an empty
text has an empty list and decodes to ''. Special strings inside texts
(``<s>``) are ordinary characters. Equal texts get equal ids; row order, extra
columns and an empty table pass through unchanged. Texts are encoded whole.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
BATCH_CHARS = 1 << 19
BATCH_IDS = 1 << 18
BATCH_SEGMENTS = 1 << 14
# Fixed values of the public sentencepiece_model.proto: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    unk_surface: str = " ⁇ "
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of one protobuf message; nested messages stay bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"not a sentencepiece model: wire type {wire}")
        yield key >> 3, value


def parse_model(data: bytes) -> Model:
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            model.pieces.append(piece[1].decode())
            model.scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
            model.kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            trainer = dict(_fields(value))
            model.model_type = trainer.get(3, UNIGRAM)
            model.byte_fallback = bool(trainer.get(35, 0))
            model.unk_surface = trainer.get(44, model.unk_surface.encode()).decode()
        elif number == 3:
            normalizer = dict(_fields(value))
            model.charsmap = normalizer.get(2, b"")
            model.add_dummy_prefix = bool(normalizer.get(3, 1))
            model.remove_extra_whitespaces = bool(normalizer.get(4, 1))
            model.escape_whitespaces = bool(normalizer.get(5, 1))
    if model.model_type not in (UNIGRAM, BPE):
        raise ValueError(f"model type {model.model_type} is neither unigram nor BPE")
    return model


def splits_at_marks(model: Model) -> bool:
    """True if no piece holds a mark after another character or a line feed: then text can be cut at these."""
    return not any(MARK in p.lstrip(MARK) or "\n" in p for p, k in zip(model.pieces, model.kinds) if k == NORMAL)


def _merges(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that join to a piece, best score first."""
    ids = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k in (NORMAL, UNUSED)}
    found = []
    for piece, i in ids.items():
        for cut in range(1, len(piece)):
            left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
            if left is not None and right is not None:
                found.append((-model.scores[i], i, left, right))
    return [(model.pieces[a], model.pieces[b]) for _, _, a, b in sorted(found)]


def build_tokenizer(data: bytes):
    """A ``tokenizers.Tokenizer`` that gives the same ids as the model file."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    model = parse_model(data)
    unknown = model.kinds.index(UNKNOWN) if UNKNOWN in model.kinds else None
    if model.model_type == BPE:
        core = models.BPE(
            vocab={p: i for i, p in enumerate(model.pieces)},
            merges=_merges(model),
            unk_token=None if unknown is None else model.pieces[unknown],
            fuse_unk=True,
            byte_fallback=model.byte_fallback,
        )
    else:
        # A control piece gets a spelling that no text has, and no piece a score below the worst
        # ordinary one, from which the library derives the cost of unknown characters.
        worst = min((s for s, k in zip(model.scores, model.kinds) if k == NORMAL), default=0.0)
        vocab = [
            (f"\U0010ffff{p}" if k in (CONTROL, UNUSED) else p, s if k in (NORMAL, USER_DEFINED) else worst)
            for p, s, k in zip(model.pieces, model.scores, model.kinds)
        ]
        core = models.Unigram(vocab, unk_id=unknown, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if splits_at_marks(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}\\n]+|{MARK}+|\\n"), "isolated")
    back = [decoders.Replace(MARK, " ")]
    if model.byte_fallback:
        back.append(decoders.ByteFallback())
    back.append(decoders.Fuse())
    if model.add_dummy_prefix:
        back.append(decoders.Strip(" ", 1, 0))
    tokenizer.decoder = decoders.Sequence(back)
    return tokenizer


@lru_cache(maxsize=2)
def _loaded(path: str):
    with open(path, "rb") as file:
        return build_tokenizer(file.read())


def plain_processor(data: bytes):
    """The sentencepiece library's processor, without the mark it puts before a text.

    A later copy of a message field overrides the earlier one when a protobuf is read.
    """
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=data + b"\x1a\x02\x18\x00")


class Encoder:
    """Encodes whole texts with the tokenizers library, each distinct segment once while it is cached.

    Where the vocabulary lets text be cut (``splits_at_marks``), ids of a text are
    those of its segments in order. Missing segments of many texts go to
    the library in one multithreaded batch; the cache is emptied when full.
    With ``verify``, each of them is also compared with the sentencepiece library.
    """

    SEGMENT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")

    def __init__(self, data: bytes, cached: int = 150_000, verify: bool = False):
        self.model = parse_model(data)
        self.tokenizer = build_tokenizer(data)
        self.cached, self.cache, self.wrong = cached, {}, set()
        simple = not self.model.charsmap and not self.model.remove_extra_whitespaces and self.model.escape_whitespaces
        self.cuts = simple and splits_at_marks(self.model)
        self.plain = plain_processor(data) if verify and self.cuts else None
        if verify and not self.cuts:
            import sentencepiece

            self.plain = sentencepiece.SentencePieceProcessor(model_proto=data)
        if self.cuts:
            self.tokenizer.normalizer = self.tokenizer.pre_tokenizer = None

    def _learn(self, segments: list[str]) -> None:
        if len(self.cache) + len(segments) > self.cached:
            self.cache.clear()
            self.wrong.clear()
        for first in range(0, len(segments), BATCH_SEGMENTS):
            some = segments[first : first + BATCH_SEGMENTS]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            self.cache.update((s, array("i", ids).tobytes()) for s, ids in zip(some, found))
            if self.plain is not None:
                expected = self.plain.encode([s.replace(MARK, " ") for s in some], num_threads=1)
                self.wrong.update(s for s, a, b in zip(some, found, expected) if a != b)

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """(ids of each text as packed 32-bit integers, whether the sentencepiece library agreed)."""
        if not self.cuts:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            agreed = [True] * len(texts)
            if self.plain is not None:
                agreed = [a == b for a, b in zip(found, self.plain.encode(texts, num_threads=1))]
            return [array("i", ids).tobytes() for ids in found], agreed
        prefix = MARK if self.model.add_dummy_prefix else ""
        cut = [self.SEGMENT.findall(prefix + t.replace(" ", MARK)) if t else [] for t in texts]
        missing = set().union(*cut).difference(self.cache)
        if len(self.cache) + len(missing) > self.cached:
            missing = set().union(*cut)  # the cache is emptied, so all are needed again
        if missing:
            self._learn(list(missing))
        packed = [b"".join(map(self.cache.__getitem__, segments)) for segments in cut]
        if not self.wrong:
            return packed, [True] * len(texts)
        return packed, [self.wrong.isdisjoint(segments) for segments in cut]


@lru_cache(maxsize=1)
def _encoder(path: str, verify: bool) -> Encoder:
    with open(path, "rb") as file:
        return Encoder(file.read(), verify=verify)


class Decoder:
    """Decodes many lists of ids at once from the bytes that each piece stands for.

    Where byte pieces do not join to valid UTF-8, or a list holds an unknown or
    control piece, the tokenizers library decodes the lists of that step.
    """

    def __init__(self, data: bytes):
        model = parse_model(data)
        self.tokenizer = build_tokenizer(data)
        parts = []
        for piece, kind in zip(model.pieces, model.kinds):
            if kind == BYTE:
                parts.append(bytes([int(piece[3:-1], 16)]))
            else:
                parts.append(piece.replace(MARK, " ").encode())
        self.plain = np.array([k in (NORMAL, USER_DEFINED, BYTE) for k in model.kinds])
        self.sizes = np.array([len(p) for p in parts], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.pool = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.strip = model.add_dummy_prefix

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """One text for each slice of ``ids``; offsets start at 0."""
        if len(ids) and ids.min() >= 0 and ids.max() < len(self.sizes) and self.plain[ids].all():
            sizes, first = self.sizes[ids], self.first[ids]
            if self.strip:
                heads = offsets[:-1][np.diff(offsets) > 0]
                spaced = heads[(self.pool[first[heads]] == 32) & (sizes[heads] > 0)]
                first[spaced] += 1
                sizes[spaced] -= 1
            ends = np.concatenate([[0], np.cumsum(sizes)])
            body = self.pool[np.repeat(first - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
            cuts = ends[offsets]
            try:
                body.decode()
                joined = True
            except UnicodeDecodeError:
                joined = False
            starts = np.frombuffer(body, dtype=np.uint8)[cuts[:-1][cuts[:-1] < len(body)]]
            if joined and not ((starts & 0xC0) == 0x80).any():
                return pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(body))
        lists = [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]
        return pa.array(self.tokenizer.decode_batch(lists, skip_special_tokens=False), pa.string())


@lru_cache(maxsize=1)
def _decoder(path: str) -> Decoder:
    with open(path, "rb") as file:
        return Decoder(file.read())


def shipped(df: DataFrame, path: str) -> str:
    """Send a model file to all executors; returns the name it has there."""
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def parity(path: str, texts: list[str]) -> list[bool]:
    """For each text, whether the sentencepiece library gives the same ids and the same decoded text."""
    import sentencepiece

    own, theirs = _loaded(path), sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]
    expected = theirs.encode(texts)
    back = own.decode_batch(ids, skip_special_tokens=False)
    return [a == b and c == theirs.decode(b) for a, b, c in zip(ids, expected, back)]


def encode(
    df: DataFrame,
    model_path: str,
    text_col: str = "text",
    ids_col: str = "ids",
    parity_col: str | None = None,
    threads: int = 2,
) -> DataFrame:
    """``df`` with the list of token ids of each whole text; a column of that name is replaced.

    ``parity_col`` adds whether the sentencepiece library gives the same ids (null for a null text).
    ``threads`` is the number of threads that the tokenizers library uses in one task.
    """
    name = shipped(df, model_path)
    added = [T.StructField(ids_col, T.ArrayType(T.IntegerType()))]
    if parity_col:
        added.append(T.StructField(parity_col, T.BooleanType()))
    kept = [f for f in df.schema.fields if f.name not in (ids_col, parity_col)]
    schema = T.StructType([*kept, *added])

    def run(batches):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        encoder = _encoder(SparkFiles.get(name), bool(parity_col))
        for batch in batches:
            for part in slices(batch, pc.binary_length(batch.column(text_col)), BATCH_CHARS):
                texts = part.column(text_col)
                packed, agreed = encoder.encode(pc.fill_null(texts, "").to_pylist())
                sizes = np.array([len(p) // 4 for p in packed], dtype=np.int32)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(packed), dtype=np.int32))
                absent = texts.is_null()
                ids = pa.ListArray.from_arrays(pa.array(offsets), values)
                if texts.null_count:
                    ids = pc.if_else(absent, pa.nulls(len(ids), ids.type), ids)
                columns = [*(part.column(f.name) for f in kept), ids]
                if parity_col:
                    columns.append(pc.if_else(absent, pa.scalar(None, pa.bool_()), pa.array(agreed, pa.bool_())))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text that each list of token ids stands for; a column of that name is replaced."""
    name = shipped(df, model_path)
    kept = [f for f in df.schema.fields if f.name != text_col]
    schema = T.StructType([*kept, T.StructField(text_col, T.StringType())])

    def run(batches):
        decoder = _decoder(SparkFiles.get(name))
        for batch in batches:
            for part in slices(batch, pc.list_value_length(batch.column(ids_col)), BATCH_IDS):
                ids = part.column(ids_col)
                sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
                offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                column = decoder.decode(ids.flatten().to_numpy(zero_copy_only=False), offsets)
                if ids.null_count:
                    column = pc.if_else(ids.is_null(), pa.scalar(None, pa.string()), column)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in kept), column], [*(f.name for f in kept), text_col]
                )

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, sizes: pa.Array, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose sizes add up to about ``limit``, so memory does not depend on rows per batch."""
    sizes = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False)
    row, total = 0, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    while row < batch.num_rows:
        end = max(int(np.searchsorted(total, total[row] + limit, side="right")) - 1, row + 1)
        yield batch.slice(row, end - row)
        row = end
