"""The queries opN_<name> of this package over the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from paperlake.llm import quality_classifier
from paperlake.llm.collocations import phrases, phrases_sql
from paperlake.llm.html_extraction import extract_text
from paperlake.llm.language_id import held_out, predict, train
from paperlake.llm.mixing import mix_sources, mixing_sql
from paperlake.llm.ngram_join import near_duplicates
from paperlake.llm.pseudonyms import pseudonymise
from paperlake.llm.quality_rules import judge_quality, quality_sql
from paperlake.llm.registry import QUERIES, SQL, query, table  # noqa: F401
from paperlake.llm.sentencepiece_model import decode, encode
from paperlake.llm.token_counts import count_tokens
from paperlake.llm.url_filter import SPAM_GLOBS, Rule, judge_urls, rules_sql
from paperlake.llm.vp_search import nearest
from paperlake.llm.whitening import fit, identity_error, whiten

MODEL = "piece_bpe_32k.model"


def model_path() -> str:
    return public_tokenizers.path(MODEL)


@query("op2_sentencepiece")
def op2_sentencepiece(spark, sf_dir):
    """doc_id, ids, n_tokens, parity (ids as the sentencepiece library gives them), round_trip (decodes to the text)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = decode(encode(docs, model_path(), parity_col="parity"), model_path())
    return both.select(
        "doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "parity",
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


@query("op8_token_counts")
def op8_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, model_path(), limit=4096)


URL_RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


@query("op10_url_filter", rules_sql(URL_RULES, blocked=SPAM_GLOBS))
def op10_url_filter(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, blocked=SPAM_GLOBS).drop("url")


@query("op7_quality_rules", quality_sql())
def op7_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge_quality(docs).drop("text", "cleaned")


@query("op3_ngram_join")
def op3_ngram_join(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op9_language_id")
def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    apart = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    model = train(docs.where(~apart))
    found = predict(docs.select("doc_id", "text", apart.alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "accepted")


OP6_SQL = """
    WITH usable AS (
        SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
        WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    pairs AS (
        SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
               sqrt(list_reduce(list_transform(range(1, len(c.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])),
                                lambda a, b: a + b)) AS score
        FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM pairs)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10"""


@query("op6_vp_search", OP6_SQL)
def op6_vp_search(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, relax=1.0)


PSEUDONYM_KEY = b"a key of the caller; this one is for trials"


@query("op5_pseudonyms")
def op5_pseudonyms(spark, sf_dir):
    """doc_id, the text with pseudonyms, n_pii, pii_kinds and pii_spans."""
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)


@query("op4_mixing", mixing_sql())
def op4_mixing(spark, sf_dir):
    """doc_id, topic, n_tokens, weight, probability (both to six places) and sampled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    found = mix_sources(docs).withColumns({c: F.round(c, 6) for c in ("weight", "probability")})
    return found.select("doc_id", "topic", "n_tokens", "weight", "probability", "sampled")


@query("op1_html_extraction")
def op1_html_extraction(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op11_whitening")
def op11_whitening(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    model = fit(vectors, components=32)
    whitened = whiten(vectors, model).select("vec_id", "deviation", "whitened")
    explained = F.array(*[F.lit(e) for e in model.explained]).cast("array<double>")
    rows = whitened.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return rows.select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("k")).alias("explained"), F.lit(identity_error(whitened, model)).alias("identity_error"),
    )


@query("op13_phrases", phrases_sql())
def op13_phrases(spark, sf_dir):
    return phrases(table(spark, sf_dir, "documents").select("text", "lang"), top=2000)


@query("op12_quality_classifier")
def op12_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    apart = F.coalesce(quality_classifier.held_out(F.col("doc_id")), F.lit(False))
    model = quality_classifier.train(docs, labels.where(~apart))
    found = quality_classifier.predict(docs.select("doc_id", "text", apart.alias("held_out")), model)
    return found.select("doc_id", "held_out", "score", "predicted")
