"""Code, markup and log jobs, over sources and logs derived from the base tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions.rows import unroll_fields
from quillmill.operators import code, logs
from quillmill.plans import pipelines as p
from quillmill.plans.registry import registered
from quillmill.sources import derived as d
from quillmill.sources.readers import documents, table
from quillmill.suite import sql as q


def src(s, sf):
    return d.code_documents(s, sf)


def col(fn):
    return lambda s, sf: src(s, sf).select("doc_id", fn(F.col("text")).alias("text_out"))


def out(df):
    return df.select("doc_id", "text_out")


def pages(s, sf):
    return table(s, sf, "pages")


def _fenced(s, sf):
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Here is the file:\n```python\n"), F.col("text"), F.lit("```\n")))
    return src(s, sf).select("doc_id", code.unfence(F.coalesce(text, F.col("text"))).alias("text_out"))


def _ledger(s, sf):
    done = p.run_stages(src(s, sf), p.CODE)
    return unroll_fields(done, ["doc_id"], "ledger").groupBy("stage").agg(
        F.count("*").alias("documents"), F.sum("tokens_removed").alias("tokens_removed"))


def _matrix(s, sf):
    return p.algorithm_matrix(src(s, sf), ["whitespace", "regex", "minifier", "squeeze", "trailing_strip", "newline_collapse",
                                           "ws_normalize", "comment_prune"])


QUERIES = {
    "c1_whitespace": col(code.compact_whitespace),
    "c2_imports": lambda s, sf: out(code.consolidate_imports(src(s, sf))),
    "c2b_import_inventory": lambda s, sf: code.import_inventory(src(s, sf)),
    "c3_code_fence": _fenced,
    "c4_comments_markup": lambda s, sf: pages(s, sf).select("page_id", code.drop_comments(F.col("html")).alias("text_out")),
    "c4b_comments_generic": lambda s, sf: code.drop_comments_generic(src(s, sf)).drop("text"),
    "c4c_hash_and_docstrings": col(code.strip_hash_and_docstrings),
    "c4c_basic_cleanup": col(code.basic_cleanup),
    "c4c_minify": col(code.minify),
    "c4c_squeeze": lambda s, sf: pages(s, sf).select("page_id", code.squeeze_whitespace(F.col("html")).alias("text_out")),
    "c5_unreachable": lambda s, sf: out(code.drop_unreachable(src(s, sf))),
    "c5_unreachable_plain": lambda s, sf: out(code.drop_unreachable_plain(src(s, sf))),
    "c6_duplicate_blocks": lambda s, sf: out(code.drop_duplicate_blocks(src(s, sf))),
    "c6b_clone_groups": lambda s, sf: code.clone_groups(src(s, sf)).drop("digest"),
    "c7_control_flow": col(code.flatten_flow),
    "c8_symbols": lambda s, sf: code.symbol_table(src(s, sf)),
    "c8_symbol_text": col(code.symbol_text),
    "c9_output_cleanup": col(code.clean_code_output),
    "c10_log_summary": lambda s, sf: logs.summarise_logs(d.log_lines(s, sf)),
    "c10_log_levels": lambda s, sf: logs.log_levels(d.log_lines(s, sf)),
    "c10b_error_templates": lambda s, sf: logs.error_templates(d.log_lines(s, sf)),
    "c11_tracebacks": lambda s, sf: out(logs.summarise_traceback(d.traceback_documents(s, sf))),
    "c12_long_output": lambda s, sf: out(logs.summarise_output(documents(s, sf))),
    "c13_code_pipeline": _ledger,
    "c14_code_matrix": _matrix,
    "c14_registry_matrix": lambda s, sf: p.algorithm_matrix(src(s, sf), registered("code")),
}

TRIPLES = f"""
triple AS (SELECT doc_id, generate_subscripts(u, 1) - 1 AS pos, unnest(u) AS w FROM (
  SELECT doc_id, flatten(list_transform(list_transform({q.sentences('text')}, lambda s: regexp_extract_all(lower(s), '[a-z]+')),
    lambda w: list_transform(range(0, len(w), 3), lambda i: [w[i + 1], coalesce(w[i + 2], 'x'), coalesce(w[i + 3], 'x')]))) AS u FROM documents)),
part AS (SELECT doc_id, pos, w[1] AS a, w[2] AS b, w[3] AS c FROM triple)"""
_N = "chr(10)"
_IMPORTS = f"'from ' || b || ' import ' || c || {_N} || 'import ' || a || {_N} || {_N} || {_N} || {_N}"
_DEF = (f"'def ' || a || '(' || b || '):   ' || {_N} || '    # ' || c || {_N} || '    url = ''http://' || a || '''  // link' || {_N} || "
        f"'    value = ' || b || {_N} || '    return value' || {_N} || '        ' || c || '()' || {_N} || '    pass' || {_N}")
CODE = f"""{TRIPLES},
code AS (SELECT d.doc_id, coalesce(t, '') AS text FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg({_IMPORTS} || {_DEF}, '' ORDER BY pos) AS t FROM part GROUP BY 1) x ON x.doc_id = d.doc_id)"""


def rx(c: str, *rules) -> str:
    for pat, rep in rules:
        rep = rep if rep.startswith("chr(") else "'" + rep + "'"
        c = f"regexp_replace({c}, '{pat}', {rep}, 'g')"
    return c


BLANK_LINES = ("\\n\\s*\\n+", "chr(10)")


def _code_sql(expr: str) -> str:
    return f"WITH {CODE} SELECT doc_id, {expr} AS text_out FROM code"


_URL_SAFE = "replace(replace(text, '://', chr(1)), '//', chr(3))"
_LINES = "string_split(c, chr(10))"
_KW = "(" + ", ".join(f"'{k}'" for k in code.KEYWORDS) + ")"
_MATRIX = {
    "regex": q.trim(rx("text", ("#[^\\n]*", ""), BLANK_LINES)),
    "minifier": q.trim(rx("text", ("#[^\\n]*", ""), (":\\s*[\\w\\[\\], |]+\\s*=", " ="), ("->\\s*[\\w\\[\\], |]+:", ":"), BLANK_LINES, ("  +", " "))),
    "squeeze": q.trim(rx("text", ("[ \\t]+", " "), ("\\n\\s*\\n", "chr(10)"), ("(?m)^\\s+", ""))),
    "trailing_strip": rx("text", ("\\s+#[^\\n]*", "")),
    "newline_collapse": q.trim(rx("text", ("\\n{3,}", "chr(10)||chr(10)"))),
    "ws_normalize": q.trim(rx("text", ("(?m)[ \\t]+$", ""))) + " || chr(10)",
    "comment_prune": q.trim(rx("text", ("//[^\\n]*", ""), ("--[^\\n]*", ""), ("#[^\\n]*", ""), BLANK_LINES)),
    "whitespace": rx(q.trim(rx("text", ("(?m)[ \\t]+$", ""), ("\\n{3,}", "chr(10)||chr(10)"))), ("([^\\n])  +", "\\1 ")),
}
_LOG = """
log AS (SELECT strftime(ts, '%Y%m%d')::INT AS doc_id, event_id AS pos,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level,
  strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') || ' ' || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN'
  WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END || ' user=' || (user_id % 3) || ' type=' || event_type || ' shard=' || substr('abcdefghijklmnop', (event_id % 16 + 1)::INT, 1) AS line FROM events)"""
_LEVELS = ("ERROR", "WARN", "INFO", "DEBUG", "FATAL", "TRACE")

SQL = {
    "c1_whitespace": _code_sql(_MATRIX["whitespace"]),
    "c2_imports": f"""WITH {CODE}, f AS (SELECT doc_id, b AS module, array_to_string(list_sort(list_distinct(list(c))), ', ') AS names FROM part GROUP BY 1, 2),
        fl AS (SELECT doc_id, string_agg('from ' || module || ' import ' || CASE WHEN length(names) > 60 THEN '(' || names || ')' ELSE names END, {_N} ORDER BY module) AS t FROM f GROUP BY 1),
        pl AS (SELECT doc_id, string_agg('import ' || a, {_N} ORDER BY a) AS t FROM (SELECT DISTINCT doc_id, a FROM part) GROUP BY 1),
        rest AS (SELECT doc_id, string_agg({_N} || {_N} || {_N} || {_DEF}, '' ORDER BY pos) AS t FROM part GROUP BY 1)
        SELECT d.doc_id, coalesce({q.trim(f"pl.t || {_N} || fl.t || {_N} || {_N} || rest.t")}, '') AS text_out FROM documents d
        LEFT JOIN pl USING (doc_id) LEFT JOIN fl USING (doc_id) LEFT JOIN rest USING (doc_id)""",
    "c2b_import_inventory": f"""WITH {CODE}, m AS (SELECT doc_id, a AS module FROM part UNION ALL SELECT doc_id, b FROM part)
        SELECT module, count(DISTINCT doc_id) AS files, count(*) AS uses FROM m GROUP BY 1""",
    "c3_code_fence": _code_sql(f"CASE WHEN doc_id % 2 = 0 THEN {q.trim('text')} ELSE text END"),
    "c4_comments_markup": "SELECT page_id, " + q.trim(rx(
        "html", ("^#![^\\n]*\\n?", ""), ("<!--[\\s\\S]*?-->", ""), ("//[^\\n]*", ""), ("/\\*[\\s\\S]*?\\*/", ""), ("--[^\\n]*", ""), ("#[^\\n]*", ""),
        BLANK_LINES)) + " AS text_out FROM pages",
    "c4b_comments_generic": f"""WITH {CODE}, x AS (SELECT doc_id, {rx(f"replace({rx(_URL_SAFE, ('(?m)\\x03.*$', ''))}, chr(1), '://')", ("\\n{3,}", "chr(10)||chr(10)"), ("(?m)[ \\t]+$", ""))} AS c FROM code),
        l AS (SELECT doc_id, {_LINES} AS ls FROM x),
        y AS (SELECT doc_id, ls, list_filter(ls, lambda l, i: {q.trim('l')} <> '' OR i = 1 OR {q.trim('ls[i - 1]')} <> '') AS kept FROM l)
        SELECT doc_id, {q.join('kept', _N)} AS text_out, len(ls)::INT AS lines_before, len(kept)::INT AS lines_after, (len(ls) - len(kept))::INT AS lines_removed FROM y""",
    "c4c_hash_and_docstrings": _code_sql(_MATRIX["regex"]),
    "c4c_basic_cleanup": _code_sql(q.trim(rx("text", ("#[^\\n]*", ""), ("\\n\\s*\\n", "chr(10)")))),
    "c4c_minify": _code_sql(_MATRIX["minifier"]),
    "c4c_squeeze": "SELECT page_id, " + _MATRIX["squeeze"].replace("text", "html") + " AS text_out FROM pages",
    "c5_unreachable": _code_sql(q.trim(rx("text", ("(\\n    return value)\\n        [a-z]+\\(\\)", "\\1"), ("\\n    pass", ""), BLANK_LINES))),
    "c5_unreachable_plain": _code_sql(q.trim(rx("text", ("(\\n    return value)\\n        [a-z]+\\(\\)\\n    pass", "\\1"), BLANK_LINES))),
    "c6_duplicate_blocks": f"""WITH {CODE}, blk AS (SELECT *, {_DEF} || coalesce(lead({_IMPORTS}) OVER w, '') AS block,
          [a, b, c, lead(a) OVER w, lead(b) OVER w, lead(c) OVER w] AS names FROM part WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
        sh AS (SELECT *, list_transform(names, lambda n: CASE WHEN n IS NULL THEN '-' WHEN n IN {_KW} THEN n ELSE '_' END) AS shape FROM blk),
        rn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, shape ORDER BY pos) AS rn, count(*) OVER (PARTITION BY doc_id) AS n FROM sh),
        j AS (SELECT doc_id, any_value(n) AS n, arg_min({_IMPORTS}, pos) || string_agg(block, {_N} ORDER BY pos) FILTER (rn = 1) AS t FROM rn GROUP BY 1)
        SELECT doc_id, CASE WHEN coalesce(n, 0) < 2 THEN text ELSE t END AS text_out FROM code LEFT JOIN j USING (doc_id)""",
    "c6b_clone_groups": f"""WITH {CODE}, blk AS (SELECT *, [a, b, c, lead(a) OVER w, lead(b) OVER w, lead(c) OVER w] AS names FROM part WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
        sh AS (SELECT *, list_transform(names, lambda n: CASE WHEN n IS NULL THEN '-' WHEN n IN {_KW} THEN n ELSE '_' END) AS shape FROM blk)
        SELECT count(*)::BIGINT AS copies, count(DISTINCT doc_id) AS files, arg_min(doc_id, (doc_id, pos)) AS first_file,
        arg_min(pos, (doc_id, pos))::INT AS first_pos FROM sh GROUP BY shape HAVING count(*) > 1""",
    "c7_control_flow": _code_sql(rx("text", ("    value = ([a-z]+)\\n    return value", "    return \\1"))),
    "c8_symbols": f"""WITH {CODE} SELECT doc_id, 'function' AS kind, pos::INT AS pos, a AS name, b AS detail FROM part
        UNION ALL SELECT doc_id, 'import', pos::INT, a, '' FROM part UNION ALL SELECT doc_id, 'from_import', pos::INT, b, c FROM part""",
    "c8_symbol_text": _code_sql(q.trim(rx("'[NEX.CODE.V2]' || chr(10) || text", ("class\\s+(\\w+)", "[CLS:\\1]"), ("(?m)import\\s+(.+?)\\s*;?$", "[IMP:\\1]"), ("//[^\\n]*", ""), ("\\s+", " ")))),
    "c9_output_cleanup": _code_sql(q.trim(rx("text", ("\\s+#[^\\n]*", ""), ("\\n{3,}", "chr(10)||chr(10)"), ("(?m)[ \\t]+$", ""))) + " || chr(10)"),
    "c10_log_levels": f"""WITH {_LOG} SELECT doc_id, count(*) AS lines, {", ".join(f"count(*) FILTER (level = '{v}') AS {v.lower()}" for v in _LEVELS)},
        count(*) FILTER (level = 'ERROR') AS error_count, count(*) FILTER (level = 'WARN') AS warn_count FROM log GROUP BY 1""",
    "c10_log_summary": f"""WITH {_LOG}, n AS (SELECT doc_id, count(*) AS lines, count(*) FILTER (level = 'ERROR') AS error_count, count(*) FILTER (level = 'WARN') AS warn_count,
          concat_ws(', ', {", ".join(f"CASE WHEN count(*) FILTER (level = '{v}') > 0 THEN '{v}=' || count(*) FILTER (level = '{v}') END" for v in _LEVELS)}) AS dist FROM log GROUP BY 1 HAVING count(*) >= 50),
        e AS (SELECT doc_id, regexp_replace(line, '\\d+', 'N', 'g') AS tpl, min(pos) AS pos, arg_min(line, pos) AS line FROM log WHERE level = 'ERROR' GROUP BY 1, 2),
        e10 AS (SELECT doc_id, string_agg('  • ' || line, {_N} ORDER BY pos) AS t FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rk FROM e) WHERE rk <= 10 GROUP BY 1),
        w5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rk FROM log WHERE level = 'WARN') WHERE rk <= 5),
        w AS (SELECT doc_id, min(pos) AS pos, arg_min(line, pos) AS line FROM w5 GROUP BY doc_id, regexp_replace(line, '\\d+', 'N', 'g')),
        wt AS (SELECT doc_id, string_agg('  • ' || line, {_N} ORDER BY pos) AS t FROM w GROUP BY 1)
        SELECT n.doc_id, lines, error_count, warn_count, concat_ws({_N}, '[LOG_SUMMARY]', 'Total lines: ' || lines, 'Level distribution: ' || dist,
          {_N} || 'ERRORS (' || error_count || '):' || {_N} || e10.t, {_N} || 'WARNINGS (' || warn_count || '):' || {_N} || wt.t) AS summary
        FROM n LEFT JOIN e10 USING (doc_id) LEFT JOIN wt USING (doc_id)""",
    "c10b_error_templates": f"""WITH {_LOG} SELECT regexp_replace(line, '\\d+', 'N', 'g') AS tpl, count(*) AS hits, min(line) AS sample FROM log GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
    "c11_tracebacks": f"""WITH {TRIPLES}, f AS (SELECT doc_id, list('  File "/srv/' || a || '/' || b || '.py", line ' || (pos + 1) || ', in ' || c ORDER BY pos) AS frames,
          list('  ' || a || '/' || b || '.py:' || (pos + 1) || ' in ' || c ORDER BY pos) AS short, arg_min(a, pos) AS msg FROM part GROUP BY 1)
        SELECT d.doc_id, CASE WHEN f.doc_id IS NULL THEN 'Traceback (most recent call last):' || {_N} || 'ValueError: '
          WHEN len(frames) + 2 >= 50 THEN '[TRACE_SUMMARY]' || {_N} || 'ERR: ValueError: ' || msg || {_N} || 'STACK (bottom→top):' || {_N} || array_to_string(short[-5:], {_N})
          ELSE 'Traceback (most recent call last):' || {_N} || array_to_string(frames, {_N}) || {_N} || 'ValueError: ' || msg END AS text_out
        FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id""",
    "c12_long_output": f"""WITH l AS (SELECT doc_id, text, string_split({q.trim('text')}, {_N}) AS ls FROM documents),
        p AS (SELECT doc_id, text, ls, unnest(list_concat(ls[1:5], list_transform(list_filter(ls, lambda x, i: i > 5 AND i <= len(ls) - 5 AND
            regexp_matches(x, '(?i)\\b(error|fail|exception|critical|warning|timeout|refused|denied)\\b')), lambda x: substr(x, 1, 200)), ls[-5:])) AS line,
            generate_subscripts(list_concat(ls[1:5], list_transform(list_filter(ls, lambda x, i: i > 5 AND i <= len(ls) - 5 AND
            regexp_matches(x, '(?i)\\b(error|fail|exception|critical|warning|timeout|refused|denied)\\b')), lambda x: substr(x, 1, 200)), ls[-5:]), 1) AS i FROM l WHERE len(ls) >= 50),
        u AS (SELECT doc_id, line, min(i) AS i, len(any_value(ls)) AS n FROM p GROUP BY 1, 2),
        j AS (SELECT doc_id, '[OUTPUT_SUMMARY: ' || any_value(n) || ' lines → ' || count(*) || ' key lines]' || {_N} || string_agg(line, {_N} ORDER BY i) AS t FROM u GROUP BY 1)
        SELECT l.doc_id, coalesce(t, text) AS text_out FROM l LEFT JOIN j USING (doc_id)""",
    "c14_code_matrix": f"WITH {CODE}, m AS (" + " UNION ALL ".join(
        f"SELECT '{k}' AS algorithm, {q.tokens('text')} AS t0, {q.tokens(f'({v})')} AS t1 FROM code" for k, v in _MATRIX.items()) + f"""),
        z AS (SELECT *, {q.pct('t0', 't1')} AS pct FROM m)
        SELECT algorithm, count(*) AS documents, sum(t0)::BIGINT AS tokens_before, sum(t1)::BIGINT AS tokens_after, round(avg(pct), 4)::DOUBLE AS avg_pct,
        quantile_disc(pct, 0.5) AS median_pct FROM z GROUP BY 1""",
}

_HEAD = f"'from ' || b || ' import ' || c || {_N} || 'import ' || a || {_N}"
_BODY = f"'def ' || a || '(' || b || '):   ' || {_N} || '    url = ''http:' || {_N} || '    value = ' || b || {_N} || '    return value' || {_N}"
_DEAD = f"'        ' || c || '()' || {_N} || '    pass' || {_N}"
_NEXT = ("CASE WHEN lead(a) OVER w IS NULL THEN '' ELSE 'from ' || lead(b) OVER w || ' import ' || lead(c) OVER w || " + _N
         + " || 'import ' || lead(a) OVER w || " + _N + " END")
_MERGED = ("list_transform(list_sort(list_distinct(list_transform(fl, lambda x: split_part(x, ' ', 2)))), lambda m: 'from ' || m || ' import ' || "
           + q.let("array_to_string(list_sort(list_distinct(list_transform(list_filter(fl, lambda x: split_part(x, ' ', 2) = m), lambda x: split_part(x, ' ', 4)))), ', ')",
                   "j", "CASE WHEN length(j) > 60 THEN '(' || j || ')' ELSE j END") + ")")
_STEPS = ("comments", "unreachable", "duplicates", "flow", "imports", "whitespace")
# The text after each stage of the code chain, built from the words each source was made of.
SQL["c13_code_pipeline"] = f"""WITH {CODE},
  b0 AS (SELECT *, [a, b, lead(b) OVER w, lead(c) OVER w, lead(a) OVER w] AS names, {_BODY} || {_NEXT} AS block, lead(a) OVER w IS NULL AS is_last,
         row_number() OVER w AS at FROM part WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
  b1 AS (SELECT *, list_transform(names, lambda n: CASE WHEN n IS NULL THEN '-' WHEN n IN {_KW} THEN n ELSE '_' END) AS shape FROM b0),
  b2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, shape ORDER BY pos) AS rn FROM b1),
  t AS (SELECT doc_id, count(*) AS n, {q.trim(f"string_agg({_HEAD} || {_BODY} || {_DEAD}, '' ORDER BY pos)")} AS t1, {q.trim(f"string_agg({_HEAD} || {_BODY}, '' ORDER BY pos)")} AS t2,
        arg_min({_HEAD}, pos) || string_agg(CASE WHEN is_last THEN rtrim(block, {_N}) ELSE block END, {_N} ORDER BY pos) FILTER (rn = 1) AS t3 FROM b2 GROUP BY 1),
  u AS (SELECT code.doc_id, text AS t0, coalesce(t1, '') AS t1, coalesce(t2, '') AS t2, CASE WHEN coalesce(n, 0) < 2 THEN coalesce(t2, '') ELSE t3 END AS t3 FROM code LEFT JOIN t USING (doc_id)),
  v AS (SELECT *, regexp_replace(t3, '    value = ([a-z]+)\\n    return value', '    return \\1', 'g') AS t4 FROM u),
  l AS (SELECT *, list_filter(string_split(t4, {_N}), lambda x: starts_with(x, 'from ')) AS fl, list_filter(string_split(t4, {_N}), lambda x: starts_with(x, 'import ')) AS pl,
        list_filter(string_split(t4, {_N}), lambda x: NOT starts_with(x, 'from ') AND NOT starts_with(x, 'import ')) AS rest FROM v),
  y AS (SELECT *, {q.trim(f"array_to_string(list_concat(list_sort(list_distinct(pl)), {_MERGED}, [''], rest), {_N})")} AS t5 FROM l),
  z AS (SELECT *, {_MATRIX["whitespace"].replace("text", "t5")} AS t6 FROM y)
  {" UNION ALL ".join(f"SELECT '{s}' AS stage, count(*) AS documents, sum(greatest(0, {q.tokens(f't{i}')} - {q.tokens(f't{i + 1}')}))::BIGINT AS tokens_removed FROM z" for i, s in enumerate(_STEPS))}"""
