"""Guideline texts are searched where a pattern may match, and only those that are asked for."""

import sys

import pytest
from pyspark.sql import functions as F

from paperlake import fixed_values as fixed
from paperlake.operators.guidelines import recommendations, split_guidelines
from paperlake.plans.guidelines import ingest_guidelines

SECTIONS = "guideline_id long, section_index int, heading string, content string"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_parts_have_no_letter_with_odd_capitals(spark):
    parts = [*sum(fixed.STRENGTH_PARTS, ()), *fixed.EVIDENCE_RU_PARTS, *fixed.EVIDENCE_EN_PARTS, *fixed.CONTRAINDICATION_PARTS]
    letters = sorted({c for p in [*parts, *sum(fixed.PREGNANCY_PARTS, ())] for c in p})
    every = [(chr(c),) for c in range(sys.maxunicode + 1) if chr(c).isalpha() or c < 0x3000 and not 0xD800 <= c < 0xE000]
    found = spark.createDataFrame(every, "c string").where(F.col("c").rlike(f"(?iu)^[{''.join(letters)}]$"))
    assert {r[0] for r in found.where(~F.lower("c").isin(letters)).collect()} == set()


@pytest.mark.parametrize(
    "text, strength, level, pregnancy, against",
    [
        ("We ſtrongly recommend rest. Evıdence LEVEL b.", "strong", "B", "unknown", []),
        ("НЕ РЕКОМЕНДУЕТСЯ при беременности. Доказательство C", "not_recommended", "C", "contraindicated", []),
        ("Рекᲂмендуется рекомендуем покой. Применяться при беременᲂсти", "conditional", "expert_opinion", "unknown", []),
        ("Рекомендуется покой. C осторожностью, ОСТᲂРОЖНОСТЬЮ при беременности", "conditional", "expert_opinion", "caution", []),
        ("Настоятельно рекомендуем покой. Прᲂтивопоказан детям. Не ᲁле.", "strong", "expert_opinion", "unknown", ["детям"]),
        ("Рекомендуем покой. Не слеᲁует применять детям.", "conditional", "expert_opinion", "unknown", ["детям"]),
    ],
)
def test_letters_that_match_without_being_capitals(frame, text, strength, level, pregnancy, against):
    found = recommendations(frame([(1, 0, "h", text)], SECTIONS)).collect()
    assert strength in {r.strength for r in found}
    assert (found[0].evidence_level, found[0].pregnancy, found[0].contraindications) == (level, pregnancy, against)


def test_null_and_empty_texts_hold_nothing(frame):
    assert recommendations(frame([(1, 0, "h", None), (2, 0, None, "")], SECTIONS)).collect() == []


def test_patterns_run_behind_their_parts(frame):
    assert plan(recommendations(frame([(1, 0, "h", "We recommend rest.")], SECTIONS))).count("Contains(_lowered") > 12


def test_only_asked_guidelines_are_searched(frame):
    rows = [(k, 0, "h", f"We recommend part {k}.") for k in (1, 2, 2, None)]
    ids = frame([(2,), (2,), (None,)], "guideline_id long")
    found = recommendations(frame(rows, SECTIONS), ids)
    assert [r.text for r in found.collect()] == ["part 2.", "part 2."]
    lines = plan(found).splitlines()
    assert next(k for k, s in enumerate(lines) if "Generate" in s) < next(k for k, s in enumerate(lines) if "LeftSemi" in s)


def test_texts_of_one_id_are_not_paired(frame):
    texts = [(1, "a", "H\nWe recommend rest.", 1), (1, "a", "H\nWe recommend sleep.", 9), (2, "b", "H\nWe recommend rest.", 5)]
    made = ingest_guidelines(frame(texts, "guideline_id long, title string, text string, seq long"))
    assert {r.source_id for r in made["registered"].collect()} == {1}  # by the last text of an id
    assert "max(seq" in plan(made["registered"])


@pytest.mark.parametrize(
    "text, expected",
    [
        ("One line", [("One line", "One line")]),
        (" Head \nBody\n More \n\nNext\n\n \n\n", [("Head ", "Body\n More"), ("Next", "Next")]),
        ("", [("", "")]),
        ("a\n\n\n\n b ", [("a", "a"), ("", ""), ("b", " b")]),
        ("a\n\n\nb\n\n  c\n", [("a", "a"), ("b", "\nb"), ("c", "  c")]),
    ],
)
def test_headings_and_contents(frame, text, expected):
    rows = split_guidelines(frame([(1, text)], "guideline_id long, text string")).orderBy("section_index").collect()
    assert [(r.heading, r.content) for r in rows] == expected
