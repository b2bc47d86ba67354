import random

from quillmill.operators import code, logs
from quillmill.plans import pipelines as p
from tests import brute


def test_whitespace_and_imports(one, docs, texts_of):
    assert one(code.compact_whitespace, "a  =  1   \n\n\n\nb\t\n") == ["a = 1\n\nb"]
    src = "import os\nfrom a import y\nx = 1\nimport sys, os\nfrom a import (x, z)\n"
    assert texts_of(code.consolidate_imports(docs(src, "plain"))) == [
        "import os\nimport sys\nfrom a import x, y, z\n\nx = 1", "plain"]
    wide = "from pkg import " + ", ".join(f"name_{i:02d}" for i in range(9))
    assert texts_of(code.consolidate_imports(docs(wide)))[0].startswith("from pkg import (name_00")
    inv = {r["module"]: (r["files"], r["uses"]) for r in code.import_inventory(docs(src, "import os")).collect()}
    assert inv == {"os": (2, 3), "sys": (1, 1), "a": (1, 2)}


def test_comments(one, docs):
    assert one(code.drop_comments, "#!/bin/sh\na // x\nb /* c\nd */ e -- f\n<!-- g\n--> h # i\n") == ["a \nb  e \n h"]
    assert one(code.strip_hash_and_docstrings, 'x = 1 # c\n"""doc\nstring"""\n\n\ny') == ["x = 1 \ny"]
    # The hint pattern runs over line ends, as specified: the colon of a body's header may go with it.
    assert one(code.minify, "a: int = 1\ndef f() -> str:\n    return  2") == ["a = 1\ndef f() :\n return 2"]
    assert one(code.squeeze_whitespace, "  a \t b\n\n   c") == ["a b\nc"]
    r = code.drop_comments_generic(docs("u = 'http://x' // y\n\n\n\n/* z */\nv  \n \n \nw")).collect()[0]
    assert r["text_out"] == "u = 'http://x' \n\n\nv\n\n\nw".replace("\n\n\n", "\n\n").replace(" \n", "\n")
    assert r["lines_removed"] == r["lines_before"] - r["lines_after"]


def test_fence_and_output(one):
    assert one(code.unfence, "Intro\n```python\nx = 1\n```\nrest", "none") == ["x = 1", "none"]
    assert one(code.clean_code_output, "a\t= 1  # note\n\n\n\n\nb  ") == ["a    = 1\n\nb\n"]


def test_unreachable_matches_brute_force(docs, texts_of):
    rng = random.Random(9)
    parts = ["return x", "raise E", "pass", "y = 1", "", "  ", "break", "if a:", "returned = 2", "else:"]
    texts = ["\n".join(" " * (4 * rng.randint(0, 3)) + rng.choice(parts) for _ in range(rng.randint(1, 25)))
             for _ in range(150)]
    assert texts_of(code.drop_unreachable(docs(*texts))) == [brute.reachable(t) for t in texts]


def test_unreachable_plain(docs, texts_of):
    assert texts_of(code.drop_unreachable_plain(docs("def f():\n    return 1\n    x = 2\ny = 3"))) == ["def f():\n    return 1\ny = 3"]


def test_duplicate_blocks(docs, texts_of):
    a = "def add(a, b):\n    # one\n    return a + 1\n"
    b = "def plus(x, y):\n    return x + 2\n"
    c = "def other(x):\n    yield x\n"
    assert texts_of(code.drop_duplicate_blocks(docs("import os\n" + a + b + c, a))) == ["import os\n" + a + "\n" + c, a]
    groups = code.clone_groups(docs(a, b + c)).collect()
    assert [(g["copies"], g["files"], g["first_file"]) for g in groups] == [(2, 2, 0)]


def test_flow(one):
    assert one(code.flatten_flow, "    v = f(1)\n    return v\n", "if a:\n    return True\nreturn False",
               "if a:\n    return False\nreturn True", "return 1\nelse:\nx") == [
        "    return f(1)\n", "return bool(a)", "return not bool(a)", "return 1\nx"]


def test_symbols(docs, one):
    rows = code.symbol_table(docs("import os\nfrom a.b import c, d\nclass K:\n    async def m(self, x):\n        pass\n")).collect()
    assert {(r["kind"], r["name"], r["detail"]) for r in rows} == {
        ("import", "os", ""), ("from_import", "a.b", "c, d"), ("class", "K", ""), ("function", "m", "self, x")}
    assert one(code.symbol_text, "function f(a, b) { }\nclass K\n") == ["[NEX.CODE.V2] [FN:f(a, b)] } [CLS:K]"]


def test_log_summary_row_and_table_agree(docs):
    rng = random.Random(3)
    def log(n):
        return "\n".join(f"2024-01-{i % 28 + 1:02d} {rng.choice(['ERROR', 'WARN', 'INFO', 'FATAL', 'DEBUG'])} job {rng.randint(1, 30)} "
                         f"step {rng.choice('abcdefghijklmno')}" + "x" * rng.choice([0, 300]) for i in range(n))
    df = docs(log(49), log(50), log(200), "one line")
    rows = {r["doc_id"]: r for r in logs.summarise_logs(logs.split_lines(df)).collect()}
    whole = {r["doc_id"]: r["text_out"] for r in logs.summarise_log_text(df).collect()}
    assert set(rows) == {1, 2}
    assert all(whole[i] == rows[i]["summary"] for i in rows)
    errors = rows[2]["summary"].split("ERRORS (")[1].split("\n\nWARNINGS")[0]
    assert errors.count("•") == 10 and max(len(x) for x in errors.split("\n")) <= 204


def test_traceback(docs, texts_of):
    frames = "".join(f'  File "/srv/app/mod{i}.py", line {i}, in fn{i}\n    call()\n' for i in range(25))
    out = texts_of(logs.summarise_traceback(docs("Traceback (most recent call last):\n" + frames + "ValueError: bad input", "x")))
    assert out[0].split("\n")[:2] == ["[TRACE_SUMMARY]", "ERR: ValueError: bad input"]
    assert out[0].split("\n")[3:] == [f"  app/mod{i}.py:{i} in fn{i}" for i in range(20, 25)] and out[1] == "x"


def test_long_output(docs, texts_of):
    lines = [f"row {i}" for i in range(60)]
    lines[30] = "a Timeout happened"
    out = texts_of(logs.summarise_output(docs("\n".join(lines))))[0].split("\n")
    assert out[0] == "[OUTPUT_SUMMARY: 60 lines → 11 key lines]" and out[6] == "a Timeout happened" and len(out) == 12


def test_code_pipeline_ledger(docs):
    src = "import os\nimport os\n# c\ndef f():\n    v = 1\n    return v\n        dead()\n"
    r = p.run_stages(docs(src), p.CODE).collect()[0]
    assert r["text_out"] == "import os\n\ndef f():\n  return 1"
