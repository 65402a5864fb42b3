import pytest
from pyspark.sql import functions as F

from paperlake.operators.chunking import chunk, chunk_fixed, chunk_sections, chunk_sentences, register_chunker
from paperlake.operators.parsing import (
    captions, extraction_stats, figures, ocr_candidates, parse_documents, pipe_tables, references, sections, with_metadata,
)

BODY = """A Study of Ears
Abstract
This abstract describes the whole study in one line.
Introduction
The introduction explains why the study was done at all.
2. Methods
Patients were examined twice over two years.
2.1 Statistical Analysis
We used a t-test for all the comparisons here.
RESULTS
Hearing improved in most of the patients.
WHY NOW?
It is a question that a heading may ask in capitals.
References
[1] Smith J. "A great title". J Med. 2020. doi: 10.1000/xyz.
(2) Doe J. Other work (2019)
3. Roe. Third."""


def docs(frame, *texts):
    return frame([(f"d{i}", t) for i, t in enumerate(texts)], "document_id string, text string")


def test_fixed_chunks(frame):
    text = " ".join(f"word{i}" for i in range(25))
    rows = chunk_fixed(docs(frame, text), 10, 2, 5).collect()
    assert [r.chunk_id for r in rows] == [f"d0_chunk_{i:04d}" for i in range(len(rows))]
    assert [r.text.split()[0] for r in rows] == ["word0", "word8", "word16", "word24"]
    assert [r.word_count for r in rows] == [10, 10, 9, 1]
    assert [r.token_count for r in rows] == [13, 13, 11, 1]
    assert rows[0].previous_chunk == "" and rows[1].previous_chunk == "d0_chunk_0000"
    assert rows[1].next_chunk == "d0_chunk_0002" and rows[2].next_chunk == "" and rows[3].next_chunk == ""


def test_fixed_chunks_may_link_to_a_dropped_one(frame):
    text = " ".join(["longerword"] * 8 + ["a", "b"])
    literal = chunk_fixed(docs(frame, text), 8, 1, 8).collect()
    assert [r.next_chunk for r in literal] == ["d0_chunk_0001", ""]
    short = " ".join(["longerword"] * 8 + ["a"])
    assert chunk_fixed(docs(frame, short), 8, 0, 8).collect()[0].next_chunk == "d0_chunk_0001"
    assert chunk_fixed(docs(frame, short), 8, 0, 8, link_kept=True).collect()[0].next_chunk == ""


def test_fixed_chunks_check_arguments(frame):
    with pytest.raises(ValueError):
        chunk_fixed(docs(frame, "x"), 10, 10)
    with pytest.raises(ValueError):
        chunk_fixed(docs(frame, "x"), 10, 2, 11)
    assert chunk_fixed(docs(frame, "", "   ")).count() == 0


def test_sentence_chunks(frame):
    text = '  First sentence is here. Second one is "long" enough! Tiny. and not split here? "Quoted start is a new one."  '
    rows = [r.text for r in chunk_sentences(docs(frame, text)).collect()]
    assert rows == [
        "First sentence is here.", 'Second one is "long" enough!', "Tiny. and not split here?", '"Quoted start is a new one."',
    ]


def test_sections(frame):
    found = [(r.heading, r.level) for r in sections(docs(frame, BODY)).collect()]
    assert found == [
        ("Abstract", 1), ("Introduction", 1), ("Statistical Analysis", 2), ("RESULTS", 1), ("WHY NOW?", 1), ("References", 1),
    ]
    assert sections(docs(frame, BODY)).collect()[1].content.endswith("Patients were examined twice over two years.")
    short = sections(docs(frame, "tiny")).collect()
    assert [(r.heading, r.content) for r in short] == [("Body", "tiny")]


def test_section_chunks(frame):
    schema = "document_id string, text string, sections array<struct<heading:string,content:string,level:int>>"
    rows = [
        ("a", "whole text", [("H", "long enough content here", 1), ("S", "short", 1)]),
        ("b", " whole text ", []),
        ("c", "whole text", [("S", "short", 1)]),
    ]
    got = {r.chunk_id: (r.section, r.heading, r.text) for r in chunk_sections(frame(rows, schema)).collect()}
    assert got == {
        "a_chunk_0000": ("H", "H", "long enough content here"),
        "b_chunk_0000": ("Body", "Body", "whole text"),
        "c_chunk_0000": ("Body", "", "whole text"),
    }


def test_chunker_registry(frame):
    register_chunker("whole", lambda df: df.select("document_id", "text"))
    assert chunk(docs(frame, "x"), "whole").count() == 1
    with pytest.raises(ValueError):
        chunk(docs(frame, "x"), "nope")


def test_references(frame):
    found = references(docs(frame, BODY)).where("raw_text not like 'A Study%'").collect()
    last = found[-3:]
    assert [r["index"] for r in last] == ["1", "2", "3"]
    assert (last[0].doi, last[0].year, last[0].title) == ("10.1000/xyz", 2020, "A great title")
    assert last[1].year == 2019 and last[2].raw_text == "Roe. Third."
    many = "\n".join(f"[{i}] Ref {i}" for i in range(1, 700))
    assert references(docs(frame, many)).count() == 699
    assert references(docs(frame, many), limit=500).count() == 500
    assert [r.raw_text for r in references(docs(frame, "no numbers")).collect()] == ["no numbers"]


def test_pipe_tables(frame):
    text = "Intro\n| Name | Age | City |\n|----------|-----|-----|\n| Al | 3 | X |\nstray\n| Bo | 4 | Y |\n  \nend\n| only |"
    pages = frame([("d", 2, text)], "document_id string, page_number int, text string")
    first, second = pipe_tables(pages).collect()
    assert first.headers == ["Name", "Age", "City"] and first.rows == [["Al", "3", "X"], ["Bo", "4", "Y"]]
    assert first.markdown.splitlines()[1] == "|---|---|---|" and first.page_number == 2
    assert second.headers == ["only"] and second.rows == []
    assert len(pipe_tables(pages, strict=True).collect()[0].rows) == 3


def test_captions_and_figures(frame):
    text = "Figure 1. One\nmore\n\nother\nFIG. 2 Two\nFig 3 Three\na\nb\nc\nd\ne"
    pages = frame([("d", 1, text, 4)], "document_id string, page_number int, text string, n_images int")
    expected = ["Figure 1. One more", "FIG. 2 Two", "Fig 3 Three a b c d"]
    assert [r.caption for r in captions(pages).collect()] == expected
    assert [r.caption for r in figures(pages).orderBy("image_index").collect()] == [*expected, ""]


def test_ocr_candidates(frame):
    rows = [("d", 1, " " * 80 + "x", 1), ("d", 2, "x" * 60, 1), ("d", 3, "x", 0)]
    pages = frame(rows, "document_id string, page_number int, text string, n_images int")
    assert [r.page_number for r in ocr_candidates(pages).collect()] == [1]


def test_metadata(frame):
    r = with_metadata(docs(frame, "\n\n" + BODY)).collect()[0]
    assert r.title == "A Study of Ears"
    assert r.abstract == "This abstract describes the whole study in one line."
    long = "T\nAbstract\n" + "word " * 800
    assert with_metadata(docs(frame, long)).collect()[0].abstract == ("word " * 800).strip()
    assert len(with_metadata(docs(frame, long), abstract_chars=1500).collect()[0].abstract) <= 1500
    assert with_metadata(docs(frame, "no such part")).collect()[0].abstract == ""


def test_parsed_document(frame):
    half = BODY.index("RESULTS")
    rows = [("d", 2, BODY[half:], 1), ("d", 1, BODY[: half - 1], 0)]
    parsed = parse_documents(frame(rows, "document_id string, page_number int, text string, n_images int"))
    row = parsed.collect()[0]
    assert row.text == BODY
    assert row.markdown.startswith("# A Study of Ears\n\n## Abstract\n\nThis abstract")
    assert "### Statistical Analysis\n" in row.markdown and "![(untitled)](figure_2_0.png)" in row.markdown
    assert "## References\n" in row.markdown and row.markdown.rstrip().endswith("[3] Roe. Third.")
    stats = extraction_stats(parsed).collect()[0]
    assert (stats.total_pages, stats.sections_found, stats.figures_found, stats.status) == (2, 6, 1, "completed")
    failed = parsed.withColumn("errors", F.array(F.lit("tables: broken")))
    assert extraction_stats(failed).collect()[0].status == "partial"


def test_parsing_needs_no_shuffle(frame):
    plan = sections(docs(frame, BODY))._jdf.queryExecution().toString()
    assert "Exchange" not in plan
    assert plan.split("== Physical Plan ==")[1].count("INSET") <= 1, "the section array is computed once"
