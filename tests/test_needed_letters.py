"""Rules that run only over texts with letters they need, and sorting without a comparator."""

from pyspark.sql import functions as F

from quillmill.functions.patterns import needed
from quillmill.functions.text import unicode
from quillmill.operators import dedup, ranking, rules


def test_letters_that_every_match_holds():
    assert needed(r"(?i)\bmeeting\s+notes?\b") == ["meeting"]
    assert needed(r"(?i)\b(?:one|three)s?\b") == ["one", "three"]
    assert needed(r"(?i)(abc)?de") is None and needed(r"(?i)abc|d") is None and needed(r"(?i)(?=abc)x") is None
    assert needed(r"(?x)ab c") is None and needed(r"(?i)\Qabc\E") is None and needed(r"(?i)[abc]+") is None and needed("(?i)(abc") is None


def test_a_rule_that_an_earlier_one_may_bring_about_runs_always():
    bounded = rules.rule_set("t", [("abc", "the word here"), ("word", "x"), ("other", "")], bounded=True)
    assert rules.needs(bounded) == [["abc"], None, ["other"]]
    joining = rules.rule_set("t", [("abc", ""), (r"\bword\b", "x")])
    assert rules.needs(joining) == [["abc"], None]
    assert rules.needs(rules.rule_set("t", [(r"\b(abc)\b", "$1"), (r"\bword\b", "x")]))[1] is None


def test_rules_rewrite_as_one_after_the_other(spark):
    texts = ["", None, "Pivot and pıvot, PİVOT", "next steps", "meeting notes\nand Meeting  NOTE", "buſineſs as usual", "docKer, docker",
             "Sure! of course I'd be happy to help me", "perSureSure, haps", "data protection officer", "general data protection regulation",
             "please, could you execute in order to generate", "AS AN AI model, thank you. It's important to note that x", "databases database"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for name, own in rules.RULE_SETS.items():
        plain = F.col("t")
        for r in own:
            plain = F.regexp_replace(plain, unicode(r.pattern), r.replacement)
        assert df.where(~rules.rewrite(F.col("t"), own).eqNullSafe(plain)).count() == 0, name


def test_words_are_looked_for_before_a_pattern_runs(spark):
    df = spark.createDataFrame([("x",)], "t string").select(rules.rewrite(F.col("t"), rules.DOMAIN).alias("o"))
    assert df._jdf.queryExecution().optimizedPlan().toString().lower().count("contains(") >= len(rules.DOMAIN)


def test_hashes_and_ranks_are_sorted_without_a_comparator(docs):
    for op in (dedup.drop_redundant, dedup.drop_redundant_plain, ranking.rank_tfidf, ranking.condense):
        plan = op(docs("A b c. D e f. G h i.")).select("text_out")._jdf.queryExecution().analyzed().toString()
        assert "array_sort(transform(array_distinct" not in plan and "array_sort(transform(slice" not in plan


def test_words_of_a_sentence_are_counted_once_not_for_each_of_them(docs):
    plan = ranking.rank_by_corpus(docs("One two three. Four five six.", "One two. Seven."), top=2)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.split("\n")
    count = [i for i, x in enumerate(lines) if "size(filter(split(s#" in x]
    exploded = [i for i, x in enumerate(lines) if "Generate" in x and "word#" in x and "posexplode" in x]
    assert count and all(any(e < c for e in exploded) for c in count) and "Generate" not in lines[count[0]]
    assert not any("Generate" in lines[c + 1] and "word#" in lines[c + 1] for c in count)
