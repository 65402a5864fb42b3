import collections
import re

from paperlake.llm.quality_rules import judge_quality
from tests.llm.conftest import MIDDLE

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    repeated = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), failed,
    )


def counts(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_base_counts_and_verdicts(spark, documents):
    from paperlake.llm.queries import QUERIES

    texts = dict(documents)
    rows = {r.doc_id: r for r in QUERIES["op7_quality_rules"](spark, MIDDLE).collect()}
    assert rows.keys() == texts.keys()
    assert all(counts(rows[d]) == base(t) for d, t in texts.items())
    assert not any(r.kept and r.base_failed for r in rows.values())
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    judged = [(quality[d], r.kept) for d, r in rows.items() if d in quality and not r.base_failed]
    assert all(kept == (q == 1) for q, kept in judged)


PROSE = " ".join(f"alpha{k} beta{k}, gamma{k} delta{k} it{k}." for k in range(20))


def test_lines_are_removed_and_documents_rejected(spark):
    texts = {
        1: PROSE,
        2: PROSE + "\nHome | News | Sport | Login\n" + "We use cookies to improve this site.",
        3: PROSE + "\n\nA long line that stands here twice.\nYes.\nA long line that stands here twice.\nYes.",
        4: "\n".join(" | ".join(f"cell{k}{j}" for j in range(6)) for k in range(12)),
        5: " ".join(f"w{k}***" for k in range(60)),
        6: " ".join(f"LOUD{k}X!!" for k in range(60)),
        7: None,
        8: "",
        9: " \n\t\x0b ",
        10: "ÀÉÎ ÖÜ " * 30,
        11: "a b c " * 40,
        12: "\n".join(f"line{k} of{k} a very{k} long{k} text, which{k} is fine{k}." for k in range(5000)),
    }
    df = spark.createDataFrame([(k, t, "extra") for k, t in texts.items()] * 2, "doc_id long, text string, kept string")
    got = judge_quality(df).collect()
    assert len(got) == 24
    rows = {r.doc_id: r for r in got}
    assert all(counts(rows[k]) == base(t) for k, t in texts.items())
    assert [k for k in sorted(rows) if rows[k].kept] == [1, 2, 3, 12]
    assert rows[1].cleaned == PROSE and rows[2].cleaned == PROSE and rows[12].cleaned == texts[12]
    assert rows[3].cleaned == PROSE + "\n\nA long line that stands here twice.\nYes.\nYes."
    assert rows[7].cleaned is None and rows[8].cleaned == ""
    assert judge_quality(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = judge_quality(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
