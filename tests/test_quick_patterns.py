"""Quicker forms of patterns find what the given ones find."""

import random

import pytest
from pyspark.sql import functions as F

from quillmill.functions import vocab
from quillmill.functions.text import unicode
from quillmill.operators import code, routing

PARTS = ("def ", "class\n", "import", "from\t", "async ", "let ", "x=> ", "=> ", "int\r", "SELECT", "where ", "f(x)", "ab1(", "a.bc.d",
         "x1.y", "_", "==", "=!=", "->", ":::", "&&&", "|", "Traceback", "at a.b(", "atat  c.d(", "WARN ", "eRROR", "info\x0b", "please",
         "could you", "I need", "the ", "an", "a", " ", "\n", "is", "has", "however", "explain", "(", ")", "1", "é", "ſ", "\u212a", "\x1c")


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(3)
    rows = [("".join(rnd.choice(PARTS) + rnd.choice(("", " ")) for _ in range(rnd.randint(1, 40))),) for _ in range(1500)]
    return spark.createDataFrame([*rows, ("",), (None,)], "text string")


def test_class_patterns_count_as_given(texts):
    """Every weight apart, so no two counts can make up for each other."""
    rules = [(p, 1.0) for p, _ in (*vocab.CODE_WEIGHTS, *vocab.PROSE_WEIGHTS)]
    low = F.when(F.octet_length("text") == F.length("text"), F.concat(F.lit(" "), F.lower("text")))
    staged = texts.withColumn("low", low).withColumn("listed", routing._listed_words(F.col("low"), rules))
    for rule in rules:
        given = F.regexp_count("text", F.lit(unicode("(?im)" + rule[0]))) * 1.0
        quick = routing._weighted(F.col("text"), F.col("low"), F.col("listed"), [rule])
        assert staged.where(~quick.eqNullSafe(given)).count() == 0, rule[0]


def test_listed_words_are_counted_without_a_pattern_each(texts):
    plan = routing.classify(texts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_listed#") > 1 and "(?U)(?im)[{}" in plan


def test_log_lines_are_found_as_in_trimmed_lines(spark):
    logs = ["\n".join(["WARN "] * 6), "\n".join([" WARN x"] * 6), "\n".join(["\t2024-01-02 a"] * 3 + ["b"] * 3), "INFO \n" * 7 + "x",
            "[2024/01/02\r\n" * 5, "WARN\x0bx\n" * 5 + "end", None]
    found = [r[0] for r in spark.createDataFrame([(x,) for x in logs], "t string").select(routing.is_log_dump(F.col("t"))).collect()]
    assert found == [False, True, True, False, True, True, None]


def test_a_fenced_block_ends_at_the_first_fence_that_ends_its_line(spark):
    cases = {"```\na\n```": "a", "x\n```py\na```b\n````\ny": "a```b\n`", "```\nopen": "```\nopen", "```\n``` \n b": "", "```a`b``c\n```\n": "`b``c"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", code.unfence(F.col("t")).alias("o")).collect()
    assert {r["t"]: r["o"] for r in rows} == cases


def test_a_long_fenced_block_is_read_in_one_go(spark):
    """Backtracking at every character, or a stack that grows with the signs, would not end here."""
    body = "a `b` ``c``\n" * 200_000
    out = spark.createDataFrame([("```\n" + body + "```\n",)], "t string").select(F.length(code.unfence(F.col("t")))).first()[0]
    assert out == len(body.strip())


def test_imports_of_one_module_are_merged_wherever_they_stand(spark):
    text = "from b import z, a\nx\nimport q, p\nfrom a import ()\n  from b import (m, a)\nimport p\nfrom é import k\nimported"
    out = code.consolidate_imports(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()["text_out"]
    assert out == "import p\nimport q\nfrom a import \nfrom b import a, m, z\n\nx\nfrom é import k\nimported"


def test_imports_of_many_modules_are_not_searched_for_each(spark):
    """20,000 modules: compared in pairs these would be 400 million steps."""
    text = "\n".join(f"from m{i:05} import b{i}, a" for i in range(20_000))
    out = code.consolidate_imports(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()["text_out"]
    assert out == "\n".join(f"from m{i:05} import a, b{i}" for i in range(20_000))


def test_temporary_values_go_where_a_return_needs_them(spark):
    cases = {"a\n    v = f(1)\n    return v\n": "a\n    return f(1)\n", "a\n    v = 1\n    return w": "a\n    v = 1\n    return w",
             "a\n  v =\n  1\n  return v": "a\n  return 1", "a\n  v = 1\n  yield v": "a\n  yield 1", "v = 1": "v = 1",
             "if x:\n    return True\nreturn False": "return bool(x)", "return 1\n  else:\n  x": "return 1\n  x"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", code.flatten_flow(F.col("t")).alias("o")).collect()
    assert {r["t"]: r["o"] for r in rows} == cases


def test_names_and_keywords_are_told_apart_in_blocks(spark):
    cases = {"def f(a1):  # c\n\n   return None is not notes": "def _(_):\n return None is not _", "x='a#b'\ny = \"q\"": "_='_\n_ = 0",
             "1.5 12ab a1 _x ré": "0 12ab _ _ _é", "a \t\n\n b": "_\n _"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", code.normalised_block(F.col("t")).alias("o")).collect()
    assert {r["t"]: r["o"] for r in rows} == cases
