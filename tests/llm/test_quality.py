"""Quality rules against counts made word by word."""

import random
import re

from quillmill.llm.quality import quality

COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


def rows(spark, texts, **more):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: r for r in quality(df.selectExpr("*", *more.values()) if more else df).collect()}


def test_counts_match_a_plain_count(spark):
    draw = random.Random(1)
    texts = [None, "", "  \n\t ", "one", "a\nb\na\n\n \na ", "x#*$%&|<>", "é ü   ß", "a b c d e f g h " * 30, "a\x0bb\x0cc\rd"]
    for _ in range(60):
        words = [draw.choice("the of abc de fgh ## - é…".split()) for _ in range(draw.randint(0, 80))]
        texts.append("".join(w + draw.choice([" ", "  ", "\n", "\t"]) for w in words))
    got = rows(spark, texts)
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in COLUMNS) == counted(t), repr(t)


def test_verdicts(spark):
    prose = " ".join(f"the river {w} and its long banks were quiet in {w}" for w in "spring summer autumn winter".split())
    got = rows(spark, [prose, prose.replace(" ", "### "), "short text", (prose + " ") * 5, None])
    assert [got[i].kept for i in range(5)] == [True, False, False, False, False]
    assert [got[i].base_failed for i in range(5)] == [False, False, True, True, True]
    assert got[1].failed_rules == ["symbols per word", "stop words"]


def test_clashing_columns_empty_table_and_repeats(spark):
    got = rows(spark, ["the cat"], more="'x' as n_words")
    assert got[0].n_words == 2
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality(none).count() == 0
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert [r.n_words for r in quality(df).collect()] == [2, 2, 2]


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = quality(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_very_long_text(spark):
    text = " ".join(str(i) for i in range(200_000))
    got = rows(spark, [text, text + " " + text])
    assert got[0].n_repeat_words == 0 and got[1].n_repeat_words == 400_000
