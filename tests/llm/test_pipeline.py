import corpus_pipeline
from paperlake.llm.pseudonyms import Pseudonymiser
from paperlake.llm.queries import PSEUDONYM_KEY, model_path
from tests.llm.conftest import SMALL
from tests.llm.test_ngram_join import components


def stages(spark, docs):
    frames = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL).cache()
        frames.append(docs)
    return frames


def test_stages_against_brute_force(spark):
    import sentencepiece

    raw = spark.read.parquet(f"{SMALL}/documents.parquet")
    clean, single, private, mixed, tokens = ({r.doc_id: r for r in f.collect()} for f in stages(spark, raw))
    assert 0 < len(clean) < raw.count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert all(labels.get(d, 1) == 1 for d in clean)
    parts = components([(d, r.text) for d, r in clean.items()])
    assert set(single) == {d for d, (_, c) in parts.items() if c == d}
    worker = Pseudonymiser(PSEUDONYM_KEY)
    assert set(private) == set(single)
    assert all(r.text == worker.replace(single[d].text)[0] and r.n_chars == len(r.text) for d, r in private.items())
    assert set(mixed) <= set(private) and all(private[d] == r for d, r in mixed.items())
    assert 0.7 < sum(r.n_chars for r in mixed.values()) / sum(r.n_chars for r in private.values()) <= 1
    processor = sentencepiece.SentencePieceProcessor(model_file=model_path())
    assert set(tokens) == set(mixed)
    assert all(r.ids == processor.encode(r.text) and r.n_tokens == len(r.ids) for r in tokens.values())


def test_run_equals_the_stages(spark):
    raw = spark.read.parquet(f"{SMALL}/documents.parquet")
    expected = sorted((r.doc_id, r.text, tuple(r.ids)) for r in stages(spark, raw)[-1].collect())
    assert sorted((r.doc_id, r.text, tuple(r.ids)) for r in corpus_pipeline.run(spark, SMALL).collect()) == expected


def test_nulls_repeats_extra_columns_and_empty_table(spark):
    text = " ".join(f"alpha{k} beta{k}, gamma{k} delta{k} it{k}." for k in range(20))
    other = " ".join(f"one{k} two{k} three{k} four{k}, five{k} six{k}." for k in range(20))
    rows = [
        (1, text, "en", "a", 5, 0), (1, text, "en", "a", 5, 0), (2, text, None, None, None, 0), (None, text, "en", "a", 1, 0),
        (None, other, "en", "a", 1, 0), (3, None, "en", "a", None, 0), (4, "", "en", "b", 0, 0), (5, other, "de", "b", 9, 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int")
    frames = stages(spark, docs)
    assert all(tuple(f.columns) == corpus_pipeline.COLUMNS for f in frames[:-1])
    assert sorted((r.doc_id for r in frames[1].collect()), key=str) == [1, 5, None, None]
    assert all(f.count() == 0 for f in stages(spark, docs.limit(0)))
