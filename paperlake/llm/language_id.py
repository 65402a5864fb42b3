"""Language identification by interpolated Kneser-Ney character models (operator 9).

Characters of a text are its letters in small case; any run of others is one
space. Tasks count 4-grams by language over all labelled training rows,
Spark adds them up and derives the lower orders from the types of the higher
one, as Kneser-Ney asks. The model is sent to the workers as sorted arrays of
n-gram hashes with log probabilities and back-off weights. A text gets the
language of the lowest cross-entropy per character.

Counts cover all training rows but those held out for calibration. The model that
is broadcast holds all n-grams of all languages and grows with the distinct ones,
12 bytes for each and for each context.

Calibration holds out, per language, the ``CALIBRATION_ROWS`` distinct texts of
the smallest hashes, a tenth of its distinct texts at most. They are scored in
tasks, whole; each language gets its own limit of acceptance from its own texts. A
language of fewer than ten distinct texts takes the highest limit of the others;
if there are only such languages, all are accepted.

Defined results: a null text, or one without letters, is ``und`` with score 0
and not accepted; without training rows every text is; of languages with equal
cross-entropy the first by name wins; texts are scored whole; repeated rows are
predicted alike; an empty table gives no rows; input columns named like an added
one are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.llm.sentencepiece_model import slices
from paperlake.llm.textbytes import mix
from paperlake.session import cut_lineage

ORDER = 4
CALIBRATION_ROWS = 100  # of a language
ACCEPTED_SHARE = 0.995  # of the calibration rows of a language
CHUNK = 1 << 20
HELD = 400_000  # n-grams a task holds before it sends its counts
UNKNOWN = "und"

_SALTS = mix(np.arange(11, 11 + 2 * ORDER, dtype=np.uint64))
_SPACE = 32
_letters: list[np.ndarray] = []


def _is_letter(codes: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x30000)]))
    return (codes < len(_letters[0])) & _letters[0][np.minimum(codes, len(_letters[0]) - 1)]


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, index of each text's first one, with the total at the end)."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    first = np.concatenate([[0], np.cumsum([len(t) for t in lowered], dtype=np.int64)])
    letter = _is_letter(codes)
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    starts = first[:-1][first[:-1] < len(codes)]
    kept[starts] = letter[starts]
    kept_before = np.concatenate([[0], np.cumsum(kept)])
    return np.where(letter, codes, _SPACE)[kept].astype(np.uint64), kept_before[first]


def _grams(codes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Columns c[-3], c[-2], c[-1], c of every character; what lies before a text is spaces."""
    place = np.arange(len(codes)) - np.repeat(first[:-1], np.diff(first))
    columns = [codes]
    for back in range(1, ORDER):
        earlier = np.full(len(codes), _SPACE, dtype=np.uint64)
        earlier[back:] = codes[: len(codes) - back]
        earlier[place < back] = _SPACE
        columns.insert(0, earlier)
    return columns


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of the n-grams whose characters are given column by column."""
    total = np.full(len(columns[0]), len(columns), dtype=np.uint64)
    for column, salt in zip(columns, _SALTS):
        total = total + (column + np.uint64(1)) * salt
    return mix(total)


def _text_slices(batch: pa.RecordBatch, name: str):
    return slices(batch, pc.binary_length(batch.column(name)), CHUNK)


def count_grams(labelled: DataFrame) -> DataFrame:
    """(lang, gram, c): how often each 4-gram occurs in the texts of each language; columns lang and text."""

    def rows(counts: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {
                "lang": pa.array([lang for lang, _ in counts], pa.string()),
                "gram": pa.array([gram for _, gram in counts], pa.string()),
                "c": pa.array(list(counts.values()), pa.int64()),
            }
        )

    def run(batches):
        counts: dict = {}
        for batch in batches:
            for part in _text_slices(batch, "text"):
                langs = part.column("lang").to_pylist()
                names = sorted(set(langs))
                codes, first = characters(part.column("text").to_pylist())
                columns = _grams(codes, first)
                lang = np.repeat(np.array([names.index(x) for x in langs], dtype=np.uint64), np.diff(first))
                _, at, n = np.unique(gram_hash([*columns, lang]), return_index=True, return_counts=True)
                text = np.stack([c[at].astype(np.uint32) for c in columns], axis=1).tobytes().decode("utf-32-le", "replace")
                for k, (lang_, c) in enumerate(zip(lang[at].tolist(), n.tolist())):
                    key = (names[lang_], text[k * ORDER : (k + 1) * ORDER])
                    counts[key] = counts.get(key, 0) + c
                if len(counts) > HELD:
                    yield rows(counts)
                    counts = {}
        yield rows(counts)

    counted = labelled.mapInArrow(run, "lang string, gram string, c long")
    return counted.groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def _kneser_ney(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: (lang, gram, c, p) and (lang, context, bow)."""
    orders = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        orders[k] = orders[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
    letters = orders[1].select(F.countDistinct("gram")).first()[0]
    # below order 1 stands the uniform distribution over the letters seen
    lower = orders[1].select("lang", F.lit("").alias("shorter"), F.lit(1 / (letters + 1)).alias("q")).distinct()
    models = []
    for k in range(1, ORDER + 1):
        table = orders[k].withColumn("context", F.substring("gram", 1, k - 1)).withColumn("shorter", F.substring("gram", 2, k - 1))
        ones = F.sum((F.col("c") == 1).cast("double"))
        twos = F.sum((F.col("c") == 2).cast("double"))
        discount = table.groupBy("lang").agg(F.when(ones > 0, ones / (ones + 2 * twos)).otherwise(0.5).alias("d"))
        totals = table.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("types"))
        # a discount of 1 would leave nothing to grams seen once
        discount = discount.withColumn("d", F.least("d", F.lit(0.95)))
        contexts = totals.join(F.broadcast(discount), "lang").withColumn("bow", F.col("d") * F.col("types") / F.col("total"))
        table = table.join(contexts, ["lang", "context"]).join(lower, ["lang", "shorter"])
        own = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total")
        table = cut_lineage(table.select("lang", "gram", "c", (own + F.col("bow") * F.col("q")).alias("p")))
        models.append((table, contexts.select("lang", "context", "bow")))
        lower = table.select("lang", F.col("gram").alias("shorter"), F.col("p").alias("q"))
    return models


@dataclass
class LanguageModel:
    """Sorted hash arrays: grams[lang][k-1] and contexts[lang][k-1] are (hashes, log values) of order k."""

    langs: list[str]
    grams: list[list[tuple[np.ndarray, np.ndarray]]]
    contexts: list[list[tuple[np.ndarray, np.ndarray]]]
    floor: list[float]
    sharpness: float = 1.0
    accepted: np.ndarray | None = None  # by language, the highest entropy of an accepted prediction

    def log_probabilities(self, columns: list[np.ndarray]) -> np.ndarray:
        """One row per n-gram, one column per language."""
        hashes = [gram_hash(columns[ORDER - k :]) for k in range(1, ORDER + 1)]
        contexts = [gram_hash(columns[ORDER - k : ORDER - 1]) if k > 1 else None for k in range(1, ORDER + 1)]
        out = np.empty((len(columns[0]), len(self.langs)))
        for at in range(len(self.langs)):
            p = np.full(len(columns[0]), self.floor[at])
            for k in range(1, ORDER + 1):
                seen, value = _find(self.grams[at][k - 1], hashes[k - 1])
                if k > 1:
                    _, bow = _find(self.contexts[at][k - 1], contexts[k - 1])
                    p = p + bow  # log 1 where the context is new
                p = np.where(seen, value, p)
            out[:, at] = p
        return out

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per character by text and language, number of characters); 0 for texts without letters."""
        codes, first = characters(texts)
        n = np.diff(first)
        if not len(codes):
            return np.zeros((len(texts), len(self.langs))), n
        columns = _grams(codes, first)
        _, at, back = np.unique(gram_hash(columns), return_index=True, return_inverse=True)
        logs = self.log_probabilities([c[at] for c in columns])
        result = np.empty((len(texts), len(self.langs)))
        for k in range(len(self.langs)):
            sums = np.concatenate([[0], np.cumsum(logs[:, k][back])])
            result[:, k] = -(sums[first[1:]] - sums[first[:-1]]) / np.maximum(n, 1)
        return result, n

    def scores(self, entropies: np.ndarray) -> np.ndarray:
        shifted = np.exp(-self.sharpness * (entropies - entropies.min(axis=1, keepdims=True)))
        return shifted / shifted.sum(axis=1, keepdims=True)


def _find(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, values = table
    if not len(keys):
        return np.zeros(len(hashes), dtype=bool), np.zeros(len(hashes))
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    seen = keys[at] == hashes
    return seen, np.where(seen, values[at], 0.0)


def _arrays(frame: DataFrame, name: str, value: str, order: int, langs: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """By language, the sorted hashes of ``name`` and the logarithms of ``value``; tasks make the hashes."""

    def run(batches):
        for batch in batches:
            codes = np.frombuffer("".join(batch.column("gram").to_pylist()).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
            hashes = gram_hash(list(codes.reshape(-1, order).T)) if order else np.zeros(batch.num_rows, dtype=np.uint64)
            at = pc.index_in(batch.column("lang"), pa.array(langs, pa.string()))
            yield pa.RecordBatch.from_arrays([at, pa.array(hashes.view(np.int64)), batch.column("v")], ["at", "hash", "v"])

    rows = frame.select("lang", F.col(name).alias("gram"), F.log(value).cast("float").alias("v"))
    rows = rows.mapInArrow(run, "at int, hash long, v float").toArrow()
    at, hashes, values = (rows[c].to_numpy() for c in ("at", "hash", "v"))
    hashes = hashes.view(np.uint64)
    order_ = np.lexsort((hashes, at))
    cuts = np.searchsorted(at[order_], np.arange(1, len(langs)))
    return [(hashes[mine], values[mine]) for mine in np.split(order_, cuts)]


def _with_apart(rows: DataFrame) -> DataFrame:
    """``rows`` with ``h``, a hash of the text, and ``apart``: whether it is held out for calibration."""
    rows = rows.withColumn("h", F.xxhash64("text"))
    # ten times the sample tells how many distinct texts there are where they are few; copies are gone before the ranks,
    # and Spark limits ranks in the tasks
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    distinct = rows.select("lang", "h").distinct()
    least = distinct.withColumn("rank", rank).where(F.col("rank") <= 10 * CALIBRATION_ROWS).select("lang", "h")
    least = least.groupBy("lang").agg(F.sort_array(F.collect_set("h")).alias("hashes")).where(F.size("hashes") >= 10)
    last = cut_lineage(least.select("lang", F.element_at("hashes", (F.size("hashes") / 10).cast("int")).alias("last")))
    return rows.join(F.broadcast(last), "lang", "left").withColumn("apart", F.coalesce(F.col("h") <= F.col("last"), F.lit(False)))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model of the languages of ``labelled``; rows with a null text or language are left out."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = _with_apart(rows.where("text IS NOT NULL AND lang IS NOT NULL"))
    counts = cut_lineage(count_grams(rows.where("NOT apart").select("text", "lang")))
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    if not langs:
        return LanguageModel([], [], [], [])
    grams, contexts = [[] for _ in langs], [[] for _ in langs]
    models = _kneser_ney(counts)
    for k, (table, context) in enumerate(models, start=1):
        for into, found in ((grams, _arrays(table, "gram", "p", k, langs)), (contexts, _arrays(context, "context", "bow", k - 1, langs))):
            for at, arrays in enumerate(found):
                into[at].append(arrays)
    model = LanguageModel(langs, grams, contexts, [float(contexts[at][0][1][0]) - np.log(1e4) for at in range(len(langs))])
    return _calibrated(model, rows.where("apart").select("text", "lang", "h"))


def _calibrated(model: LanguageModel, sample: DataFrame) -> LanguageModel:
    """Choose how sharply entropies become scores, and by language the entropy beyond which a prediction is not accepted."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        seen: set = set()
        for batch in batches:
            for part in _text_slices(batch, "text"):
                keys = list(zip(part.column("lang").to_pylist(), part.column("h").to_pylist()))
                new = [key not in seen and not seen.add(key) for key in keys]
                part = part.filter(pa.array(new, pa.bool_()))
                found, n = shared.value.cross_entropies(part.column("text").to_pylist())
                entropies = pa.array(list(found), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("h"), pa.array(n, pa.int64()), entropies], ["lang", "h", "n", "entropies"])

    scored = sample.mapInArrow(run, "lang string, h long, n long, entropies array<double>").where("n > 0")
    scored = [r for r in scored.dropDuplicates(["lang", "h"]).orderBy("lang", "h").collect() if r.lang in model.langs]
    model.accepted = np.full(len(model.langs), np.inf)
    if not scored:
        return model
    entropies = np.array([r.entropies for r in scored])
    right = np.array([model.langs.index(r.lang) for r in scored])
    for at in set(right.tolist()):
        model.accepted[at] = np.quantile(entropies[right == at, at], ACCEPTED_SHARE) * 1.1
    model.accepted[np.isinf(model.accepted)] = model.accepted[np.isfinite(model.accepted)].max()

    def loss(sharpness: float) -> float:
        model.sharpness = sharpness
        return -float(np.log(model.scores(entropies)[np.arange(len(right)), right] + 1e-9).mean())

    model.sharpness = min((float(s) for s in np.geomspace(0.5, 32, 25)), key=loss)
    return model


def predict(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``df`` with lang_pred, score, cross_entropy (null for ``und``) and accepted."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    added = {"lang_pred": T.StringType(), "score": T.DoubleType(), "cross_entropy": T.DoubleType(), "accepted": T.BooleanType()}
    kept = [f for f in df.schema.fields if f.name not in added]
    out = T.StructType([*kept, *(T.StructField(k, v) for k, v in added.items())])

    def run(batches):
        model = shared.value
        names = np.array([*model.langs, UNKNOWN], dtype=object)
        for batch in batches:
            for part in _text_slices(batch, text_col):
                lang = np.full(part.num_rows, len(model.langs))
                score, entropy = np.zeros(part.num_rows), np.full(part.num_rows, np.nan)
                if model.langs:
                    found, n = model.cross_entropies(pc.fill_null(part.column(text_col), "").to_pylist())
                    some = n > 0
                    best = found.argmin(axis=1)
                    lang[some] = best[some]
                    score[some] = model.scores(found).max(axis=1)[some]
                    entropy[some] = found.min(axis=1)[some]
                columns = {
                    "lang_pred": pa.array(names[lang].tolist(), pa.string()),
                    "score": pa.array(score),
                    "cross_entropy": pa.array(entropy, mask=np.isnan(entropy)),
                    "accepted": pa.array(entropy <= np.append(model.accepted, 0.0)[lang]) if model.langs else pa.array(np.zeros(len(lang), bool)),
                }
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *columns.values()], out.names)

    return df.mapInArrow(run, out)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2
