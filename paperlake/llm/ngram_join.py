"""Near-duplicate documents by the Jaccard similarity of their word n-grams (operator 3).

Documents are rows and n-grams are columns of a sparse 0/1 matrix A; overlaps
are entries of A·Aᵀ. The product is taken in blocks of columns:

1. A scan counts n-grams into a sketch of fixed size and gives each document
   its set size and a digest of its set. Equal sets are one class from here on.
2. Each row is ordered by (sketch count, hash), rarest first. Two rows of
   similarity t or more share a column among the first ``n - ceil(t·n) + 1`` of
   each, so only these entries are dealt out, packed by block of columns.
3. Inside a block, rows that share a column are candidates if the bounds
   derived from their sizes and positions allow it. In a long column, rows
   meet the row that holds it earliest only; that is the hub of a family of
   copies, and each row keeps one hub, that of its longest column. For each
   candidate the overlap is counted over whole rows and pairs below the bound of
   their sizes are discarded.
4. Rows of a long column that are still in different components meet, all of
   them outside the column's largest component against the rest, under two
   bounds that hold in the first column that a pair shares: nothing before it is
   shared, so what follows it in the shorter rest must be enough; and of the row
   whose first entries end earlier in the order of columns, those that stand in
   no long column cannot be shared with a row it has not met before. So every
   pair that could link is counted, bounded out, or already in one component:
   components are exact.

The order of columns decides speed alone, so the sketch may be coarse. Columns
so frequent that a block would overflow are spread over blocks by document.

Defined results: without words, or with a null text, the set is empty and linked
with nothing; with fewer words than ``width`` the whole sequence is one n-gram; a
null id gives a null component and links with nothing; repeated rows are one
document; of rows of one id with different texts each has its own size, and the
set of the smallest digest decides the component of all; an empty table gives no
rows; extra columns are ignored. N-grams are told apart by 64-bit hashes, sets by
128-bit digests.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.llm.textbytes import chunks, mix, words
from paperlake.operators.identity import connected_components
from paperlake.session import cut_lineage

CELLS = 1 << 20  # of a sketch: 4 MB wherever it is sent
SKETCH_CHUNKS = 16
BLOCK = 500_000  # entries of a block of columns
SHORT_COLUMN = 4  # rows of such a column all meet at once
FLUSH = 500_000  # entries a task holds before it sends them

_SALTS = mix(np.arange(101, 165, dtype=np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each row; ASCII capitals count as small letters."""
    hashes, first = words(data, offsets, lower=True)
    full = np.zeros(max(len(hashes) - width + 1, 0), dtype=np.uint64)
    for k in range(width):
        full += hashes[k : k + len(full)] * _SALTS[k]
    full = mix(full)
    sets = []
    for start, end in zip(first[:-1].tolist(), first[1:].tolist()):
        if end - start >= width:
            sets.append(np.unique(full[start : end - width + 1]))
        elif end > start:
            short = (hashes[start:end] * _SALTS[: end - start]).sum(dtype=np.uint64, keepdims=True)
            sets.append(mix(short + _SALTS[63:] * np.uint64(end - start)))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return sets


def prefix_length(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def least_overlap(a, b, percent: int):
    """The smallest overlap of sets of a and b elements whose Jaccard similarity is percent / 100 or more."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64) & (CELLS - 1)


def _chunk_rows(counts: np.ndarray) -> list[tuple[int, bytes]]:
    size = CELLS // SKETCH_CHUNKS
    parts = counts.astype("<u4").reshape(SKETCH_CHUNKS, size)
    return [(k, zlib.compress(part.tobytes(), 1)) for k, part in enumerate(parts) if part.any()]


def _gathered(rows: DataFrame) -> np.ndarray:
    """The sum of sketches given as rows (chunk, counts); each task adds up what streams by."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                part = np.frombuffer(zlib.decompress(counts), dtype="<u4")
                sums[k] = sums[k] + part if k in sums else part.astype(np.uint64)
        clipped = [zlib.compress(np.minimum(s, 2**32 - 1).astype("<u4").tobytes(), 1) for s in sums.values()]
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(sums, pa.int32()), "counts": pa.array(clipped, pa.binary())})

    total = np.zeros((SKETCH_CHUNKS, CELLS // SKETCH_CHUNKS), dtype=np.uint32)
    for row in rows.repartition(SKETCH_CHUNKS, "chunk").mapInArrow(run, "chunk int, counts binary").collect():
        total[row.chunk] = np.frombuffer(zlib.decompress(row.counts), dtype="<u4")
    return total.reshape(-1)


def _scan(docs: DataFrame, width: int) -> DataFrame:
    """(id, n, digest) of each document, and (chunk, counts) of each task's sketch."""

    def run(batches):
        counts = np.zeros(CELLS, dtype=np.uint32)
        for batch in batches:
            for row, rows, data, offsets in chunks(batch.column("text")):
                sets = shingle_sets(data, offsets, width)
                counts += np.bincount(_cells(np.concatenate(sets)), minlength=CELLS).astype(np.uint32)
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": batch.column("id").slice(row, rows),
                        "n": pa.array([len(s) for s in sets], pa.int64()),
                        "digest": pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in sets], pa.binary()),
                        "chunk": pa.nulls(rows, pa.int32()),
                        "counts": pa.nulls(rows, pa.binary()),
                    }
                )
        found = _chunk_rows(counts)
        yield pa.RecordBatch.from_pydict(
            {
                "id": pa.nulls(len(found), pa.int64()),
                "n": pa.nulls(len(found), pa.int64()),
                "digest": pa.nulls(len(found), pa.binary()),
                "chunk": pa.array([k for k, _ in found], pa.int32()),
                "counts": pa.array([c for _, c in found], pa.binary()),
            }
        )

    return docs.mapInArrow(run, "id long, n long, digest binary, chunk int, counts binary")


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, and so on: what is alike in them is shuffled as next to nothing."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def _from_planes(parts: list[bytes], kind) -> np.ndarray:
    """The values of all parts, each made by ``_planes``."""
    width = np.dtype(kind).itemsize
    rows = [np.frombuffer(p, dtype=np.uint8).reshape(width, len(p) // width).T for p in parts]
    return np.concatenate(rows).reshape(-1).view(kind) if rows else np.zeros(0, dtype=kind)


def _entries(docs: DataFrame, sketch, blocks: int, width: int, percent: int, most: int) -> DataFrame:
    """The first entries of each row, packed by block of columns; a task sends equal sets once."""

    def packed(held: list[tuple]) -> pa.RecordBatch:
        tokens, spread = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        ids, sizes, ends = (np.array([h[k] for h in held]) for k in (2, 3, 4))
        lengths = np.array([len(h[0]) for h in held])
        row = np.repeat(np.arange(len(held), dtype=np.int32), lengths)
        places = np.arange(len(tokens), dtype="<u4") - np.repeat((np.cumsum(lengths) - lengths).astype("<u4"), lengths)
        block = (mix(tokens) % np.uint64(blocks)).astype(np.int32)
        frequent = np.flatnonzero(spread > 1)
        own = mix(ids.view(np.uint64))[row[frequent]] % spread[frequent]
        block[frequent] = (block[frequent] + own.astype(np.int64)) % blocks
        order = np.argsort(block, kind="stable")
        block, row = block[order], row[order]
        run = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (row[1:] != row[:-1])]))  # a row in a block
        cuts = np.flatnonzero(np.diff(block)) + 1
        run_cuts = np.searchsorted(run, cuts)
        of = {  # numbers of a row are sent once for each block it has entries in
            "tokens": (tokens[order], cuts), "places": (places[order], cuts),
            "spread": ((spread[order] > 1).astype(np.uint8), cuts), "ids": (ids[row[run]], run_cuts),
            "sizes": (sizes[row[run]].astype("<u4"), run_cuts), "ends": (ends[row[run]], run_cuts),
            "runs": (np.diff(np.append(run, len(row))).astype("<u4"), run_cuts),
        }
        columns = {"block": pa.array(block[np.concatenate([[0], cuts])])}
        for name, (values, at) in of.items():
            columns[name] = pa.array([_planes(part) for part in np.split(values, at)], pa.binary())
        return pa.RecordBatch.from_pydict(columns)

    def run(batches):
        counts, seen, held, size = sketch.value, set(), [], 0
        for batch in batches:
            for row, rows, data, offsets in chunks(batch.column("text")):
                ids = batch.column("id").slice(row, rows).to_pylist()
                for id_, found in zip(ids, shingle_sets(data, offsets, width)):
                    n = len(found)
                    digest = hashlib.blake2b(found, digest_size=8).digest() if n else None
                    if id_ is None or not n or digest in seen:
                        continue
                    seen.add(digest)
                    count = counts[_cells(found)]
                    first = np.argsort(count, kind="stable")[: prefix_length(n, percent)]
                    spread = (count[first] // most + 1).astype(np.uint32)
                    held.append((found[first], spread, id_, n, _order_key(count[first[-1]], found[first[-1]])))
                    size += len(first)
                    if size >= FLUSH:
                        yield packed(held)
                        held, size = [], 0
        if held:
            yield packed(held)

    names = ("tokens", "places", "spread", "ids", "sizes", "ends", "runs")
    return docs.mapInArrow(run, ", ".join(["block int", *(f"{name} binary" for name in names)]))


def _order_key(count: np.uint32, hash_: np.uint64) -> np.float32:
    """A number in the order of columns, rarest first; columns that share one may stand in either order."""
    return np.float32(float(count) + float(hash_) / 2**64)


def _possible(a, i, b, j, percent: int, least=np.minimum, most=np.maximum):
    """Whether rows of a and b entries that share their i-th and j-th one can be similar enough."""
    before, after = least(i, j), least(a - i, b - j)
    return (100 * least(a, b) >= percent * most(a, b)) & (before + after >= least_overlap(a, b, percent))


def _candidates(ids, sizes, places, left, right, percent: int, length=None) -> pd.DataFrame:
    """(row, other, length of the column that names a hub, else 0) of entries that may stand in similar rows."""
    good = _possible(sizes[left], places[left], sizes[right], places[right], percent) & (ids[left] != ids[right])
    length = np.zeros(len(left), np.int64) if length is None else length
    return pd.DataFrame({"row": ids[right[good]], "other": ids[left[good]], "length": length[good]})


def _plain(parts: list[bytes], kind) -> np.ndarray:
    """The values of all parts, each their bytes in order."""
    return np.frombuffer(b"".join(parts), dtype=kind)


def _block_product(percent: int, read=_plain):
    """The candidates of a block; ``read`` makes the values of a column of its parts."""

    def run(table: pa.Table) -> pa.Table:
        join = lambda name, kind: read(table.column(name).to_pylist(), kind)
        tokens, spread = join("tokens", np.uint64), join("spread", np.uint8)
        runs = join("runs", "<u4")
        ids, ends = (np.repeat(join(c, kind), runs) for c, kind in (("ids", np.int64), ("ends", np.float32)))
        sizes = np.repeat(join("sizes", "<u4"), runs).astype(np.int64)
        places = join("places", "<u4").astype(np.int64)
        order = np.argsort(tokens, kind="stable")
        same = tokens[order][1:] == tokens[order][:-1]
        keep = spread[order] > 0
        keep[1:] |= same
        keep[:-1] |= same
        kept = order[keep]
        del order, same, keep
        kept = kept[np.lexsort((ids[kept], places[kept], tokens[kept]))]
        tokens, ids, sizes, places, ends, spread = (x[kept] for x in (tokens, ids, sizes, places, ends, spread))
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, int)
        lengths = np.diff(np.append(starts, len(tokens)))
        run_start, run_length = np.repeat(starts, lengths), np.repeat(lengths, lengths)
        at = np.arange(len(tokens))
        pairs = []
        for step in range(1, SHORT_COLUMN):
            left = at[(run_length <= SHORT_COLUMN) & (at + step < run_start + run_length)]
            pairs.append((left, left + step))
        left, right = (np.concatenate(x) for x in zip(*pairs))
        near = _candidates(ids, sizes, places, left, right, percent)
        near = near.drop_duplicates(["row", "other"])
        star = at[(run_length > SHORT_COLUMN) & (at > run_start)]
        hubs = _candidates(ids, sizes, places, run_start[star], star, percent, run_length[star])
        hubs = hubs.sort_values("length", kind="stable").drop_duplicates("row", keep="last")
        long = (run_length > SHORT_COLUMN) | (spread > 0)
        met = pd.concat([near, hubs])
        gap = np.zeros(len(met), np.int64)
        column = lambda first, last: pa.array(np.concatenate([first, last]))
        return pa.table(
            {
                "token": column(gap, tokens[long].view(np.int64)),
                "a": column(met["row"].to_numpy(np.int64), ids[long]),
                "b": pa.array(
                    np.concatenate([met["other"].to_numpy(np.int64), np.zeros(long.sum(), np.int64)]),
                    mask=np.arange(len(met) + long.sum()) >= len(met),
                ),
                "length": column(met["length"].to_numpy(np.int64), np.zeros(long.sum(), np.int64)),
                "n": column(gap, sizes[long]),
                "place": column(gap, places[long]),
                "ends": column(gap.astype(np.float32), ends[long]),
            }
        )

    return run


def _linked(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole rows overlap enough."""
    left = _sets_of(docs, pairs.select(F.col("a").alias("id")), width)
    right = _sets_of(docs, pairs.select(F.col("b").alias("id")), width)
    left = left.select(F.col("id").alias("a"), F.col("entries").alias("left"))
    right = right.select(F.col("id").alias("b"), F.col("entries").alias("right"))

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("left"), batch.column("right")):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                shared = len(x) + len(y) - len(np.union1d(x, y))
                good.append(shared >= least_overlap(len(x), len(y), percent))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def _sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, entries) of documents whose id is in ``ids``, and of a few others: a sketch of the ids filters the scan."""

    def mark(batches):
        counts = np.zeros(CELLS, dtype=np.uint32)
        for batch in batches:
            counts[_cells(mix(batch.column(0).to_numpy().view(np.uint64)))] = 1
        found = _chunk_rows(counts)
        yield pa.RecordBatch.from_pydict(
            {"chunk": pa.array([k for k, _ in found], pa.int32()), "counts": pa.array([c for _, c in found], pa.binary())}
        )

    wanted = docs.sparkSession.sparkContext.broadcast(
        np.packbits(_gathered(ids.mapInArrow(mark, "chunk int, counts binary")) > 0)
    )

    def run(batches):
        marks = np.unpackbits(wanted.value).astype(bool)
        for batch in batches:
            batch = batch.filter(batch.column("id").is_valid())
            batch = batch.filter(pa.array(marks[_cells(mix(batch.column("id").to_numpy().view(np.uint64)))]))
            for row, rows, data, offsets in chunks(batch.column("text")):
                entries = [s.tobytes() for s in shingle_sets(data, offsets, width)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": batch.column("id").slice(row, rows),
                        "digest": pa.array([hashlib.blake2b(e, digest_size=16).digest() for e in entries], pa.binary()),
                        "entries": pa.array(entries, pa.binary()),
                    }
                )

    found = docs.mapInArrow(run, "id long, digest binary, entries binary").where("length(entries) > 0")
    found = found.join(ids.distinct(), "id", "left_semi")
    return found.groupBy("id").agg(F.min(F.struct("digest", "entries")).alias("set")).select("id", "set.entries")


def _capped(long: DataFrame, percent: int) -> DataFrame:
    """(id, n, ends, entries) of each row, an entry being its place and token in a long column and ``cap``.

    The cap is the most that the row can share with one it has met in long columns
    only, if this column is the first: its first entries that stand in long columns,
    from this one on, and all entries beyond the first ones. It holds for partners
    whose first entries end no earlier in the order of columns.
    """
    # a row of the matrix gathers no more entries than its own document has; copies of a row bring the same ones
    rows = long.groupBy("id").agg(
        F.first("n").alias("n"), F.first("ends").alias("ends"), F.sort_array(F.collect_set(F.struct("place", "token"))).alias("e")
    )
    least = F.floor((percent * F.col("n") + 99) / 100)
    entry = lambda e, k: F.struct(e.place.alias("place"), e.token.alias("token"), (least - 1 + F.size("e") - k).alias("cap"))
    return rows.select("id", "n", "ends", F.transform("e", entry).alias("entries"))


def _bounds_allow(percent: int) -> Column:
    """Whether a pair that first meets in this column can be similar."""
    a, i, b, j = (F.col(c) for c in ("n", "place", "m", "other_place"))
    need = F.floor((percent * (a + b) + 99 + percent) / (100 + percent))
    sizes = 100 * F.least(a, b) >= percent * F.greatest(a, b)
    # of the row whose first entries end later, one may be shared with what lies beyond the first ones of the other
    cap = F.when(F.col("ends") < F.col("other_ends"), F.col("cap")).when(
        F.col("ends") > F.col("other_ends"), F.col("other_cap")
    )
    return sizes & (F.least(a - i, b - j) >= need) & (F.coalesce(cap, F.greatest("cap", "other_cap")) >= need)


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, block: int = BLOCK
) -> DataFrame:
    """(id, n_shingles, component_id) of each row of ``df``.

    The component is the smallest id reachable by links, a link being a Jaccard
    similarity of ``percent`` / 100 or more between sets of ``width``-word n-grams.
    ``block`` is the number of entries that a task multiplies at once.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scanned = cut_lineage(_scan(docs, width))
    rows = scanned.where("chunk IS NULL").select("id", "n", "digest")
    sketch = spark.sparkContext.broadcast(_gathered(scanned.where("chunk IS NOT NULL").select("chunk", "counts")))
    entries = rows.agg(F.sum(F.lit(1) + F.col("n") * (100 - percent) / 100)).first()[0] or 0
    blocks = max(spark.sparkContext.defaultParallelism, int(entries / block) + 1)

    full = rows.where("n > 0 AND id IS NOT NULL").groupBy("id").agg(F.min(F.struct("digest", "n")).alias("set"))
    full = full.select("id", "set.*")
    classes = full.groupBy("digest", "n").agg(F.min("id").alias("class"))
    member = full.join(classes, ["digest", "n"]).select("id", "class")

    shared = (
        _entries(docs, sketch, blocks, width, percent, block)
        .groupBy("block")
        .applyInArrow(_block_product(percent, _from_planes), "token long, a long, b long, length long, n long, place long, ends float")
    )
    shared = cut_lineage(shared)
    of = lambda c: member.select(F.col("id").alias(c), F.col("class").alias(f"{c}_class"))
    met = shared.where("b IS NOT NULL")
    hub = met.where("length > 0").groupBy("a").agg(F.max_by("b", F.struct("length", -F.col("b"))).alias("b"))
    pairs = met.where("length = 0").select("a", "b").union(hub).distinct().join(of("a"), "a").join(of("b"), "b")
    pairs = pairs.where("a_class <> b_class").select(
        F.least("a_class", "b_class").alias("a"), F.greatest("a_class", "b_class").alias("b")
    )
    pairs = cut_lineage(pairs.distinct())
    long = shared.where("b IS NULL").join(of("a"), "a")
    long = _capped(long.select("token", F.col("a_class").alias("id"), "n", "place", "ends"), percent)

    links = cut_lineage(_linked(pairs, docs, width, percent))
    part = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    late = cut_lineage(_late_pairs(long, part, percent).join(pairs, ["a", "b"], "left_anti"))
    links = links.union(_linked(late, docs, width, percent))
    part = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    part = part.select(F.col("node").alias("class"), "component")

    placed = member.join(part, "class", "left").select("id", F.coalesce("component", "class").alias("component"))
    return rows.join(placed, "id", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )


def _late_pairs(long: DataFrame, part: DataFrame, percent: int) -> DataFrame:
    """Pairs of a long column whose rows are in different components and may yet be similar."""
    placed = long.join(part.withColumnRenamed("node", "id"), "id", "left")
    placed = placed.select("id", "n", "ends", F.coalesce("component", "id").alias("component"), F.explode("entries").alias("e"))
    placed = cut_lineage(placed.select("id", "n", "ends", "component", "e.*"))
    largest = (
        placed.groupBy("token", "component")
        .agg(F.count(F.lit(1)).alias("c"))
        .groupBy("token")
        .agg(F.max(F.struct("c", "component")).alias("top"), F.count(F.lit(1)).alias("components"))
        .where("components > 1")
        .select("token", F.col("top.component").alias("largest"))
    )
    open_ = placed.join(largest, "token")
    other = open_.select(
        "token", F.col("id").alias("other"), F.col("n").alias("m"), F.col("place").alias("other_place"),
        F.col("ends").alias("other_ends"), F.col("cap").alias("other_cap"), F.col("component").alias("other_component"),
    )
    once = (F.col("other_component") == F.col("largest")) | (F.col("id") < F.col("other"))
    return (
        open_.where("component <> largest")
        .join(other, "token")
        .where((F.col("component") != F.col("other_component")) & once & _bounds_allow(percent))
        .select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
        .distinct()
    )
