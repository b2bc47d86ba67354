import re

from pyspark.sql import functions as F

from quillmill.operators import patternjoin as pj
from quillmill.operators import security as sec

CALLS = "call_id long, organization_id int, api_key_id long, tool_name string, params map<string,string>"
TOOLS = "tool_id int, organization_id int, tool_name string, blocked_patterns string"

LITERALS = {
    "secret\\d+": "secret", "k\": [1-3]\\d}": "k\": ", "drop table": "drop table", "abc?def": "def", "ab+cd+": None, "abb+cdef": "cdef",
    "x(long literal)?yz1": "yz1", "(a(b)c)* tail": " tail", "a|bcd": None, "(?x) abc": None, "\\x41bcd": None, "\\Qabc\\E": None,
    "\\$\\(cmd\\)": "$(cmd)", "fo{2}bar": "bar", "[abc]def": "def", "[a[bc]]def": None, "é-abc": "-abc", "ABC": "abc", "ab": None, "": None,
    "a.b.c": None, "\\w+@corp\\.example": "@corp.example", "\\\\(abc)?": None, "abc{0,}xy": None, "[^x]*xyz$": "xyz",
    "((((((((deep))))))))x": None, "abc*?def": "def", "abc+?def": "def"}


def test_required_literals(one):
    assert one(pj.required_literal, *LITERALS) == list(LITERALS.values())


def test_literals_are_in_every_match(spark):
    import random
    rnd = random.Random(5)
    parts = ["ab", "c", "x", "\\.", "(de)", "(f(g)h)?", "[ij]", "k*", "l+", "m{2}", "n?", "\\d", "^", ".", "O", "(p)+", " ", "-"]
    patterns = ["".join(rnd.choice(parts) for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    texts = ["".join(rnd.choice(["ab", "c", "x", ".", "de", "fgh", "i", "k", "l", "mm", "n", "7", "o", "p", " ", "-", "AB"])
                     for _ in range(rnd.randint(3, 12))) for _ in range(400)]
    literal = {r.p: r.l for r in spark.createDataFrame([(p,) for p in patterns], "p string").select(
        "p", pj.required_literal(F.col("p")).alias("l")).collect()}
    assert sum(x is not None for x in literal.values()) > 50
    for p in patterns:
        for t in texts:
            if re.search("(?i)" + p, t):
                assert literal[p] is None or literal[p] in t.lower(), (p, t)


def _brute(calls, tools):
    rows = []
    for call, org, _, tool, params in calls:
        for _, torg, name, lines in tools:
            if (torg, name) != (org, tool):
                continue
            for path, value in (params or {}).items():
                found = []
                for p in (x.strip(" \t\n\r\f\x0b") for x in lines.split("\n")):
                    try:
                        if p and value is not None and re.search("(?i)" + p, value):
                            found.append(p)
                    except re.error:
                        pass
                if found:
                    rows.append((call, tool, path, found[0], len(found)))
    return sorted(rows)


def test_equals_trying_every_pattern(spark):
    many = "\n".join([f"word{i}x\\d" for i in range(400)] + ["[broken", "(", "", "\\d{6}", "drop\\s+table", "a|b7", "secret", "secret"])
    tools = [(1, 1, "sql", many), (2, 1, "sql", "SECRET\nword7x"), (3, 2, "sql", "zzz"), (4, 1, "free", ""), (5, 1, "mail", "word\\d+")]
    calls = [(i, 1, 9, "sql", {"q": f"see WORD{i}x{i % 10} and drop  table", "r": "a clean value"}) for i in range(150)]
    calls += [(500, 1, 9, "sql", {"q": "top Secret", "n": None, "e": ""}), (501, 1, 9, "sql", {"q": "id 123456"}), (502, 2, 9, "sql", {"q": "secret"}),
              (503, 1, 9, "mail", {"q": "word12"}), (504, 1, 9, "none", {"q": "secret"}), (505, 1, 9, "sql", {}), (506, 1, 9, "sql", None),
              (507, 1, 9, "sql", {"q": "y" * 30000 + "word399x1" + "y" * 30000}), (500, 1, 9, "sql", {"q": "top Secret"})]
    c, t = spark.createDataFrame(calls, CALLS), spark.createDataFrame(tools, TOOLS)
    got = sorted(tuple(r) for r in sec.policy_scan_indexed(c, t).collect())
    assert got == _brute(calls, tools)
    assert sorted(tuple(r) for r in sec.policy_scan(c, t).collect()) == got


def test_empty_tables(spark):
    none_c, none_t = spark.createDataFrame([], CALLS), spark.createDataFrame([], TOOLS)
    tools = spark.createDataFrame([(1, 1, "sql", "abc")], TOOLS)
    calls = spark.createDataFrame([(1, 1, 9, "sql", {"q": "abc"})], CALLS)
    assert sec.policy_scan_indexed(none_c, tools).count() == 0 and sec.policy_scan_indexed(calls, none_t).count() == 0


def test_joins_are_on_equal_keys(spark):
    tools = spark.createDataFrame([(1, 1, "sql", "abc")], TOOLS)
    calls = spark.createDataFrame([(1, 1, 9, "sql", {"q": "abc"})], CALLS)
    plan = sec.policy_scan_indexed(calls, tools)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
