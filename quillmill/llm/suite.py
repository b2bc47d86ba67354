"""Registered queries of this folder, and their checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.quality import quality

    return quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.secret_scan import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.pii import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.mixing import mix_report

    return mix_report(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.langid import held_out, identify, learn

    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out("doc_id")))
    return identify(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quillmill.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.topk import top_k

    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows.where("vec_id % 50 = 0"), rows)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.suffix_dedup import dedup_report

    return dedup_report(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.digest_index import dedup_report

    return dedup_report(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.merkle import proofs, tampered_text

    return proofs(table(spark, sf_dir, "documents"), {"text": tampered_text()})


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_secret_scans, op3_pii, op4_mixing, op5_language_id, op6_bpe, op7_exact_top_k, op8_simhash,
    op9_suffix_array_dedup, op10_toxicity, op11_exact_dedup, op12_merkle_manifest, op13_embedding_whitening)}


def _quality_sql() -> str:
    from quillmill.llm.quality import RULES, STOP_WORDS
    from quillmill.suite.sql import BLANKS, quoted

    bounds = [f"{r.measure} >= {r.low}" for r in RULES if r.low is not None]
    bounds += [f"{r.measure} <= {r.high}" for r in RULES if r.high is not None]

    def share(part: str, total: str) -> str:
        return f"CASE WHEN {total} > 0 THEN ({part})::DOUBLE / {total} ELSE 0.0 END"

    return f"""
WITH d AS (SELECT doc_id, t, ws, list_filter(string_split(t, chr(10)), lambda x: trim(x, {BLANKS}) <> '') AS ls FROM (
       SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)),
     win AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS k FROM (
       SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
     dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
     cov AS (SELECT doc_id, sum(least(8, coalesce(nx - i, 8)))::BIGINT AS n FROM (
       SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM dup) GROUP BY doc_id),
     m AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
       (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
       (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
       len(list_filter(ws, lambda w: regexp_matches(w, '\\p{{L}}'))) AS letters,
       len(list_filter(ws, lambda w: lower(w) IN ({quoted(dict.fromkeys(STOP_WORDS))}))) AS stops,
       len(list_filter(ls, lambda x: ltrim(x, ' ')[1] IN ('-', '*', '•', '‣'))) AS bullets,
       len(list_filter(ls, lambda x: regexp_matches(rtrim(x, ' '), '(\\.\\.\\.|…)$'))) AS ellipses
       FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id),
     r AS (SELECT *, {share('word_chars', 'n_words')} AS mean_word_chars, {share('n_symbols', 'n_words')} AS symbol_ratio,
       {share('letters', 'n_words')} AS letter_ratio, {share('stops', 'n_words')} AS stop_ratio,
       {share('n_dup_lines', 'n_lines')} AS dup_line_ratio, {share('bullets', 'n_lines')} AS bullet_ratio,
       {share('ellipses', 'n_lines')} AS ellipsis_ratio,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {' AND '.join(bounds)} AS kept FROM r"""


_MIXING_SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
       substr(md5(doc_id::VARCHAR), 1, 3) AS block FROM documents),
     s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
     w AS (SELECT *, [3, 1, 2][(place % 3 + 1)::INT] AS weight FROM s),
     f AS (SELECT *, sum(source_size) OVER ()::DOUBLE * 1.5 AS total,
       coalesce(sum(source_size) OVER o, 0)::DOUBLE AS before, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS rest FROM w
       WINDOW o AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     st AS (SELECT *, (total - 2 * before) * weight > 2.0 * source_size * rest AS stops FROM f),
     g AS (SELECT source, place, source_size, CASE WHEN stops THEN (2 * source_size)::DOUBLE ELSE
       weight * (total - 2 * coalesce(sum(CASE WHEN stops THEN source_size END) OVER (), 0)::DOUBLE)
         / sum(CASE WHEN NOT stops THEN weight END) OVER ()::DOUBLE END AS target FROM st),
     b AS (SELECT source, block, sum(size)::BIGINT AS words FROM d GROUP BY source, block),
     t AS (SELECT b.*, g.place, round(g.target)::BIGINT AS goal, e.epoch FROM b JOIN g ON b.source IS NOT DISTINCT FROM g.source,
       (VALUES (0), (1)) e(epoch) WHERE b.words > 0),
     dr AS (SELECT *, least(words, goal - start) AS block_words FROM (SELECT *, sum(words) OVER (PARTITION BY place
       ORDER BY epoch, md5(block || ':' || epoch) ROWS UNBOUNDED PRECEDING) - words AS start FROM t) WHERE start < goal),
     p AS (SELECT *, sum(size) OVER (PARTITION BY source, block ORDER BY md5('row:' || doc_id), size ROWS UNBOUNDED PRECEDING) - size AS start FROM d),
     k AS (SELECT p.doc_id, sum(greatest(0, least(p.size, dr.block_words - p.start)))::BIGINT AS taken FROM p
       JOIN dr ON p.source IS NOT DISTINCT FROM dr.source AND p.block = dr.block GROUP BY p.doc_id)
SELECT d.doc_id, d.size, g.source_size, g.target, coalesce(k.taken, 0)::BIGINT AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN k ON k.doc_id = d.doc_id"""

_TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
       WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
       FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON c.vec_id <> q.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

_SUFFIX_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
     p AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (
       SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d WHERE len(h) >= 400)),
     u AS (SELECT doc_id, i FROM p JOIN (SELECT k FROM p GROUP BY k HAVING count(*) > 1) USING (k)),
     c AS (SELECT doc_id, i, CASE WHEN i > coalesce(lag(i) OVER o + 200, -1) THEN 1 ELSE 0 END AS opens FROM u
       WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
     r AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM (
       SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM c) GROUP BY doc_id, run),
     g AS (SELECT doc_id, run, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY run), 0) AS prev FROM r),
     k AS (SELECT d.doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans,
       string_agg(substr(h, (2 * prev + 1)::BIGINT, (2 * (a - prev))::BIGINT), '' ORDER BY run) || substr(any_value(h), (2 * max(b) + 1)::BIGINT) AS rest
       FROM d JOIN g USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(rest, h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

_DEDUP_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""


def _merkle_sql() -> str:
    def digest(text: str) -> str:
        values = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
        return "sha256(" + " || ".join(f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in values) + ")"

    def levels(name: str, base: str) -> str:
        return f"""{name} AS ({base} UNION ALL
       SELECT grp, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM (
         SELECT *, count(*) OVER (PARTITION BY grp, level) AS c FROM {name}) WHERE c > 1 GROUP BY grp, level, pos // 3)"""

    def sides(name: str, of: str) -> str:
        return f"""{name} AS (SELECT grp, level, pos, c, h,
         coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM (
         SELECT *, count(*) OVER (PARTITION BY grp, level) AS c FROM {of}) WINDOW w AS (PARTITION BY grp, level, pos // 3 ORDER BY pos))"""

    def way(name: str, base: str, of: str) -> str:
        return f"""{name} AS ({base} UNION ALL
       SELECT f.rid, f.grp, f.level + 1, f.pos // 3, sha256(s.l || f.cur || s.r), f.sibs || s.l || s.r
       FROM {name} f JOIN {of} s ON f.grp IS NOT DISTINCT FROM s.grp AND f.level = s.level AND f.pos = s.pos AND s.c > 1)"""

    tampered = "CASE WHEN (crc % 2) = 0 THEN replace(text, chr(10), '') ELSE text END"
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, source AS grp, {digest('text')} AS leaf, {digest(tampered)} AS shown
         FROM (SELECT *, {_crc32_sql('doc_id::VARCHAR')} AS crc FROM documents)),
     o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
     {levels('t', "SELECT grp, 0 AS level, pos, leaf AS h FROM o")},
     {sides('s', 't')},
     {way('f', "SELECT rid, grp, 0 AS level, pos, shown AS cur, '' AS sibs FROM o", 's')},
     tops AS (SELECT grp, h, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS pos FROM s WHERE c = 1),
     e AS (SELECT rid, grp, arg_max(cur, level) AS cur, arg_max(sibs, level) AS sibs FROM f GROUP BY rid, grp),
     {levels('tt', "SELECT 0 AS grp, 0 AS level, pos, h FROM tops")},
     {sides('ss', 'tt')},
     {way('ff', "SELECT rid, 0 AS grp, 0 AS level, tops.pos, cur, sibs FROM e JOIN tops ON e.grp IS NOT DISTINCT FROM tops.grp", 'ss')},
     z AS (SELECT rid, arg_max(cur, level) AS cur, arg_max(sibs, level) AS sibs FROM ff GROUP BY rid),
     root AS (SELECT h FROM ss WHERE c = 1)
SELECT doc_id, leaf, tops.h AS subroot, root.h AS root, sha256(z.sibs) AS proof_sha256, z.cur AS folded_root, z.cur = root.h AS verified
FROM d JOIN tops ON d.grp IS NOT DISTINCT FROM tops.grp JOIN z USING (rid), root"""


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    step = "CASE WHEN {0} % 2 = 1 THEN xor({0} // 2, 3988292384) ELSE {0} // 2 END"
    bits = f"list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: {step.format('x')})"
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {bits}), 4294967295::BIGINT)"


SQL: dict[str, str] = {"op1_quality_rules": _quality_sql(), "op4_mixing": _MIXING_SQL, "op7_exact_top_k": _TOP_K_SQL,
                       "op9_suffix_array_dedup": _SUFFIX_SQL, "op11_exact_dedup": _DEDUP_SQL, "op12_merkle_manifest": _merkle_sql()}
