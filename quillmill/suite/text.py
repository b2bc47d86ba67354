"""Corpus text jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions import vocab
from quillmill.functions.rows import unroll_fields
from quillmill.operators import analytics, dedup, opcode, quotes, ranking, redundancy, rules, segment, wordfilter
from quillmill.operators.routing import classify
from quillmill.plans import pipelines as p
from quillmill.plans.registry import registered
from quillmill.sources import derived as d
from quillmill.sources.readers import documents
from quillmill.suite import sql as q
from quillmill.suite.routes import CODE, PROSE
from quillmill.suite.routes import SQL as ROUTE_SQL
from quillmill.suite.usage import ALL_STOP, AUDIT

# The invented prose holds none of the fixed vocabularies, so these checks use
# words that occur in it.
CLUSTERS = {"en": ["the", "and", "of", "that", "with"], "de": ["der", "die", "und", "mit", "zu"],
            "fr": ["les", "une", "que", "dans", "pour"], "es": ["los", "que", "del", "con", "una"]}
KEYWORDS = sorted({w for ws in CLUSTERS.values() for w in ws})
SIGNALS = ["ntion", "keit", "ment", "cion"]
DATA_RULES = rules.rule_set("data", [(r"of the", "[OT]"), (r"the", "t"), (r"and", "&"), (r"und", "u"), (r"que", "q")],
                            bounded=True)


def docs(s, sf):
    return documents(s, sf).select("doc_id", "text")


def out(df):
    return df.select("doc_id", "text_out")


def _hits(s, sf):
    return rules.apply_rules(docs(s, sf), DATA_RULES, with_hits=True)


def _rules(name):
    def run(s, sf):
        """The fixed rule set over the corpus with planted phrases, one per document."""
        phrases = F.array(*[F.lit(x) for x in PLANTED[name]])
        planted = F.concat(F.element_at(phrases, (F.col("doc_id") % len(PLANTED[name]) + 1).cast("int")), F.lit(" "), F.col("text"))
        df = docs(s, sf).withColumn("text", planted)
        if name == "hedge":
            return out(df.withColumn("text_out", rules.remove_hedges(F.col("text"))))
        return out(rules.apply_rules(df, rules.RULE_SETS[name]))

    return run


# Phrases put before each document, and what the rule set makes of them.
PLANTED = {
    "hedge": {"I think, well.": ", well.", "Sure! Here it is. ": "Here it is.", "We perhaps agree; the point": "We agree; the point"},
    "vocabulary": {"The meeting notes say": "The [MTG:NOT] say", "A database and an endpoint": "A [DB] and an [EP]",
                   "cash flow and profit and loss": "[C/F] and [P&L]"},
    "polite": {"please, open it": "  open it".replace("  ", " "), "could you see of course now": " see  now"},
    "shorthand": {"in order to execute": "to run", "the database repository": "the db repo"},
    "output": {"Sure! It works": "It works", "We do it in order to win": "We do it to win"},
    "paraphrase": {"in other words, it is": "it is", "so to rephrase it": "so it"},
}


def _planted_sql(name):
    items = list(PLANTED[name].items())
    case = " ".join(f"WHEN {i} THEN '{v}'" for i, (_, v) in enumerate(items))
    return f"SELECT doc_id, CASE doc_id % {len(items)} {case} END || ' ' || text AS text_out FROM documents"


# The parts of the hedge rules that occur in the corpus.
_FILLERS = "(Sure[!,.]?\\s*|Of course[!,.]?\\s*|Certainly[!,.]?\\s*|Absolutely[!,.]?\\s*|No problem[!,.]?\\s*|Happy to help[!,.]?\\s*)"
_TO_BE = "\\x02to\\x03 \\x02be\\x03"


def _tidy(c):
    """What the hedge rules do to text without hedges: blanks and doubled punctuation."""
    flat = q.trim(f"regexp_replace({c}, '  +', ' ', 'g')")
    return f"regexp_replace(regexp_replace({flat}, '[,;]\\s*[,;]', ',', 'g'), '\\.\\s*\\.', '.', 'g')"


def _ledger(stages):
    def run(s, sf):
        done = p.run_stages(docs(s, sf), stages)
        return p.stage_ledger(done).groupBy("stage", "seq").agg(
            F.count("*").alias("documents"), F.sum("tokens_removed").alias("tokens_removed"))

    return run


def _savings_rollup(s, sf):
    df = documents(s, sf).select("doc_id", "text", "lang")
    stages = [("flat", p.column_operator(lambda c: wordfilter.drop_stop_words_flat(c, d.DATA_STOP_WORDS))),
              ("blocks", ranking.condense_blocks)]
    done = p.run_stages(df, stages)
    ledger = unroll_fields(done, ["lang"], "ledger")
    return analytics.savings_rollup(ledger)


def _by_class(s, sf):
    classes = classify(docs(s, sf), "text", CODE, PROSE).select("doc_id", "content_type")
    return analytics.savings_by_class(d.audit(s, sf), classes)


def _signal(s, sf):
    return out(ranking.keep_signal(docs(s, sf), clusters=CLUSTERS))


def _quotes(s, sf):
    """Documents with their longest stretch put in quotes."""
    quoted = docs(s, sf).withColumn("text", F.concat(
        F.lit('He said "'), F.regexp_replace("text", "[\"']", ""), F.lit('" and left, \'ok\'.')))
    return out(quotes.shorten_quotes(quoted))


def _alias(s, sf):
    twice = docs(s, sf).withColumn("text", F.concat("text", F.lit(" Main Conveyor Motor Temperature and "), "text"))
    return out(wordfilter.alias_entities(twice))


def _paragraphs(df):
    """Line breaks become paragraph breaks, so that the chunk rules have work."""
    return df.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


def _chunks(s, sf):
    return ranking.chunk_table(_paragraphs(docs(s, sf))).select(
        "doc_id", "pos", "total", F.md5("chunk").alias("chunk_md5"))


def _opcode_text(s, sf):
    """Sentences with planted commands, causes, times, errors and quantities."""
    lead = F.element_at(F.array(*[F.lit(x) for x in OPCODE_LEADS]), (F.col("doc_id") % len(OPCODE_LEADS) + 1).cast("int"))
    return opcode.encode_opcodes(docs(s, sf).withColumn("text", F.concat(lead, F.lit(" "), "text")))


OPCODE_LEADS = ("please fix the login page.", "because it failed yesterday, we stop.", "status: ok and more than 5x.",
                "It took 30 seconds.", "unless the build is green. Rate limited!")


def _matrix(s, sf):
    return p.algorithm_matrix(docs(s, sf), MATRIX)


MATRIX = ["stopword", "stopword_flat", "light_words", "redundancy", "redundancy_plain", "tfidf", "tfidf_plain", "chunking", "blocks"]


def _report(s, sf):
    return p.request_report(docs(s, sf), "blocks", 500)


def _custom_rules(s, sf):
    mine = rules.rules_from_table(d.compression_rules(s, sf), 1)
    return out(rules.apply_rules(docs(s, sf), mine))


def _dispatch(s, sf):
    mixed = docs(s, sf).unionByName(d.code_documents(s, sf).withColumn("doc_id", F.col("doc_id") + 1_000_000))
    traces = d.traceback_documents(s, sf).withColumn("doc_id", F.col("doc_id") + 2_000_000)
    done = p.compress_by_content(mixed.unionByName(traces))
    return done.groupBy("pipeline", "content_type").agg(
        F.count("*").alias("documents"), F.sum("tokens_before").alias("tokens_before"),
        F.sum("tokens_after").alias("tokens_after"))


def _messages(s, sf):
    return p.compress_messages(d.requests(s, sf)).select(
        "request_id", "total_original_tokens", "total_compressed_tokens", "message_count", "total_reduction_pct")


QUERIES = {
    "x0_sentences": lambda s, sf: segment.sentence_table(docs(s, sf)),
    "x0b_features": lambda s, sf: segment.feature_table(docs(s, sf)).groupBy("kind", "feature").agg(
        F.count("*").alias("sentences")),
    "x1_rule_engine": lambda s, sf: out(rules.apply_rules(docs(s, sf), DATA_RULES)),
    "x1_rule_hits": lambda s, sf: rules.hit_totals(_hits(s, sf)),
    "x1a_hedges": _rules("hedge"),
    "x1b_vocabulary": _rules("vocabulary"),
    "x1c_polite": _rules("polite"),
    "x1d_shorthand": _rules("shorthand"),
    "x1e_output": _rules("output"),
    "x1f_paraphrase": _rules("paraphrase"),
    "x1g_custom_rule_groups": lambda s, sf: rules.grouped_rules(d.compression_rules(s, sf), 1),
    "x1g_custom_rules": _custom_rules,
    "x2_stop_words": lambda s, sf: docs(s, sf).select("doc_id", wordfilter.drop_stop_words(F.col("text"), ALL_STOP, ["that"]).alias("text_out")),
    "x2b_stop_words_flat": lambda s, sf: docs(s, sf).select("doc_id", wordfilter.drop_stop_words_flat(F.col("text")).alias("text_out")),
    "x2c_light_words": lambda s, sf: docs(s, sf).select("doc_id", wordfilter.drop_light_words(F.col("text")).alias("text_out")),
    "x3_redundant_sentences": lambda s, sf: out(dedup.drop_redundant(docs(s, sf))),
    "x3b_redundant_plain": lambda s, sf: out(dedup.drop_redundant_plain(docs(s, sf))),
    "x3_any_length": lambda s, sf: out(redundancy.drop_redundant_any(docs(s, sf), spread_from=64)),
    "x3c_first_sentences": lambda s, sf: dedup.first_sentences(docs(s, sf)),
    "x3c_corpus_sentence_dedup": lambda s, sf: out(dedup.dedup_sentences(docs(s, sf))),
    "x3c_near_copies": lambda s, sf: dedup.near_copies(docs(s, sf)),
    "x4_tfidf": lambda s, sf: out(ranking.rank_tfidf(docs(s, sf))),
    "x4b_tfidf_plain": lambda s, sf: out(ranking.rank_tfidf_plain(docs(s, sf))),
    "x4c_corpus_tfidf": lambda s, sf: ranking.rank_by_corpus(docs(s, sf), top=2),
    "x5_signal": _signal,
    "x5b_signal_substring": lambda s, sf: out(ranking.keep_signal_substring(docs(s, sf), signals=SIGNALS)),
    "x5c_cluster_profile": lambda s, sf: ranking.cluster_profile(documents(s, sf), "lang", clusters=CLUSTERS),
    "x6_condense": lambda s, sf: out(ranking.condense(docs(s, sf))),
    "x6b_blocks": lambda s, sf: out(ranking.condense_blocks(docs(s, sf))),
    "x7_anchored": lambda s, sf: out(ranking.keep_anchored(docs(s, sf), anchors=ANCHORS)),
    "x7b_anchor_inventory": lambda s, sf: ranking.anchor_inventory(docs(s, sf), anchors=ANCHORS),
    "x8_opcodes": lambda s, sf: out(_opcode_text(s, sf)),
    "x8b_opcode_stats": lambda s, sf: opcode.opcode_stats(_opcode_text(s, sf)),
    "x9_quotes": _quotes,
    "x10_chunk_selection": lambda s, sf: out(ranking.keep_chunks(_paragraphs(docs(s, sf)))),
    "x10_chunk_table": _chunks,
    "x10b_chunk_scores": lambda s, sf: ranking.chunk_table(_paragraphs(docs(s, sf))).select(
        "doc_id", "pos", F.round("score", 6).alias("score")),
    "x11_aliases": _alias,
    "x12_standard": _ledger(p.STANDARD),
    "x13_dense": _ledger(p.DENSE),
    "x14_weight": _ledger(p.WEIGHT),
    "x15_content_dispatch": _dispatch,
    "x16_message_arrays": _messages,
    "x17_algorithm_matrix": _matrix,
    "x17_registry_matrix": lambda s, sf: p.algorithm_matrix(docs(s, sf), registered("text")),
    "x18_request_report": _report,
    "m10_a21_stage_rollup": _savings_rollup,
    "a21_savings_by_class": _by_class,
}

# Anchors without word borders, which the two engines define differently.
ANCHORS = {"digits": r"\d{2,}", "percent": r"\d+\s*%", "year": r"(?:19|20)\d{2}", "url": r"https?://\S+",
           "released": r"Released|Copyright"}

_SENT = q.sentence_rows()
_PLAIN = q.sentence_rows(plain=True)


def _rebuild(rows: str, keep: str, untouched: str) -> str:
    """Join kept sentences; documents matched by ``untouched`` keep their text."""
    return (f"SELECT d.doc_id, CASE WHEN {untouched} THEN d.text ELSE coalesce(k.t, '') END AS text_out FROM documents d "
            f"JOIN (SELECT doc_id, any_value(n) AS n, string_agg(s, ' ' ORDER BY pos) FILTER ({keep}) AS t "
            f"FROM ({rows}) GROUP BY doc_id) k ON k.doc_id = d.doc_id")


def _rule_sql():
    t = q.mark_words("text")
    steps = [("\\x02of\\x03 \\x02the\\x03", "[OT]"), ("\\x02the\\x03", "t"), ("\\x02and\\x03", "&"),
             ("\\x02und\\x03", "u"), ("\\x02que\\x03", "q")]
    for pat, rep in steps:
        t = f"regexp_replace({t}, '{pat}', '{rep}', 'gi')"
    return q.unmark(t)


_W = "list_sort(list_distinct(" + q.terms("s", 3) + "))"


def _redundant(rows: str, word_sql: str, threshold: float, with_pairs: bool) -> str:
    """Greedy removal: overlaps by join on the feature, then a fold over positions."""
    pairs = q.let(q.terms("s", 3), "t", "list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i+1]))")
    pairs = pairs if with_pairs else "[]::VARCHAR[]"
    return f"""
    sent AS ({rows}),
    feat AS (SELECT doc_id, n, pos, s, {word_sql} AS w, {pairs} AS b FROM sent),
    uw AS (SELECT doc_id, pos, len(w) AS k, unnest(w) AS f FROM feat),
    ub AS (SELECT doc_id, pos, len(b) AS k, unnest(b) AS f FROM feat),
    pw AS (SELECT x.doc_id, x.pos AS i, y.pos AS j, count(*) / (any_value(x.k) + any_value(y.k) - count(*)) AS sim
           FROM uw x JOIN uw y ON x.doc_id = y.doc_id AND x.f = y.f AND x.pos < y.pos GROUP BY 1, 2, 3),
    pb AS (SELECT x.doc_id, x.pos AS i, y.pos AS j, count(*) / (any_value(x.k) + any_value(y.k) - count(*)) AS sim
           FROM ub x JOIN ub y ON x.doc_id = y.doc_id AND x.f = y.f AND x.pos < y.pos GROUP BY 1, 2, 3),
    edge AS (SELECT DISTINCT doc_id, i, j FROM (SELECT * FROM pw UNION ALL SELECT * FROM pb) WHERE sim > {threshold}),
    back AS (SELECT doc_id, j, list(i) AS earlier FROM edge GROUP BY 1, 2),
    r AS (SELECT f.doc_id, list({{'pos': f.pos, 'back': coalesce(earlier, [])}} ORDER BY f.pos) AS rs
          FROM feat f LEFT JOIN back ON back.doc_id = f.doc_id AND back.j = f.pos WHERE len(w) > 0 GROUP BY 1),
    acc AS (SELECT doc_id, unnest(list_reduce(rs, lambda a, x: CASE WHEN len(list_intersect(a, x.back)) > 0 THEN a
            ELSE list_append(a, x.pos) END, []::BIGINT[])) AS pos FROM r)"""


_FLATTENED = ("regexp_replace(regexp_replace(text, '(?m)^\\s*[-*•]\\s+', chr(10), 'g'), '(?m)^\\s*\\d+[.)\\s]\\s+', chr(10), 'g')")
_MATRIX_BLOCKS = (
    "array_to_string(list_transform(range(1, greatest(len(ws), 1) + 1, 100), lambda b: array_to_string(list_slice("
    "string_split(regexp_replace(array_to_string(list_slice(ws, b, b + 99), ' '), '([.!?])\\s+', '\\1'||chr(1), 'g'), chr(1)), 1, 2), ' ')), ' ')")
_ANCHOR_ANY = " OR ".join(f"regexp_matches(s, '{a}')" for a in ANCHORS.values())
_CHUNK = """
para AS (SELECT doc_id, replace(text, chr(10), chr(10)||chr(10)) AS text FROM documents),
parts AS (SELECT doc_id, length(text) AS len, list_filter(list_transform(string_split(regexp_replace(text, '\\n\\s*\\n', chr(1), 'g'), chr(1)),
          lambda x: """ + q.trim("x") + """), lambda x: x <> '') AS ps FROM para WHERE length(text) >= 2000),
packed AS (SELECT doc_id, list_reduce(list_transform(ps, lambda x: {'done': []::VARCHAR[], 'open': [x], 'size': length(x)::BIGINT}),
   lambda a, x: CASE WHEN a.size + x.size >= greatest(200, len // 15)
     THEN {'done': list_append(a.done, array_to_string(list_concat(a.open, x.open), chr(10))), 'open': []::VARCHAR[], 'size': 0::BIGINT}
     ELSE {'done': a.done, 'open': list_concat(a.open, x.open), 'size': a.size + x.size} END,
   {'done': []::VARCHAR[], 'open': []::VARCHAR[], 'size': 0::BIGINT}) AS st FROM parts),
cs AS (SELECT doc_id, CASE WHEN len(st.open) > 0 THEN list_append(st.done, array_to_string(st.open, chr(10))) ELSE st.done END AS c FROM packed),
chunk AS (SELECT doc_id, len(c) AS total, unnest(generate_series(0, len(c) - 1)) AS pos, unnest(c) AS chunk FROM cs),
cw AS (SELECT *, """ + q.words("chunk") + """ AS ws FROM chunk),
scored AS (SELECT doc_id, pos, total, chunk, round(
   (len(list_distinct(list_transform(ws, lambda w: lower(w)))) / len(ws) * 3.0
    + least(0.5 * len(regexp_extract_all(""" + q.mark_words("chunk") + """, '\\x02\\d+(?:\\x03\\.\\x02\\d+)?\\x03')), 3.0)
    + least(0.3 * len(regexp_extract_all(""" + q.mark_words("chunk") + """, '\\x02[A-Z][a-z]+(?:\\x03\\s+\\x02[A-Z][a-z]+)+\\x03')), 2.0)
    + CASE WHEN pos = 0 THEN 2.0 WHEN pos = total - 1 THEN 1.5 ELSE 0.0 END)
   * CASE WHEN len(ws) < 20 THEN 0.5 WHEN len(ws) > 500 THEN 0.8 ELSE 1.0 END, 9) AS score FROM cw)"""

SQL = {
    "x0_sentences": f"SELECT doc_id, n::INT AS n, pos::INT AS pos, s AS sentence FROM ({_SENT})",
    "x0b_features": f"""WITH t AS (SELECT {q.terms('s', 3)} AS t FROM ({_SENT})),
        f AS (SELECT 'word' AS kind, unnest(list_distinct(t)) AS feature FROM t UNION ALL
              SELECT 'pair', unnest(list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i+1]))) FROM t)
        SELECT kind, feature, count(*) AS sentences FROM f GROUP BY 1, 2""",
    "x1_rule_engine": f"SELECT doc_id, {_rule_sql()} AS text_out FROM documents",
    "x1_rule_hits": f"""WITH m AS (SELECT {q.mark_words('text')} AS t FROM documents),
        h AS (SELECT 'data:001' AS rule, len(regexp_extract_all(t, '(?i)\\x02of\\x03 \\x02the\\x03')) AS n FROM m
        UNION ALL SELECT 'data:002', len(regexp_extract_all(regexp_replace(t, '(?i)\\x02of\\x03 \\x02the\\x03', '', 'g'), '(?i)\\x02the\\x03')) FROM m
        UNION ALL SELECT 'data:003', len(regexp_extract_all(t, '(?i)\\x02and\\x03')) FROM m
        UNION ALL SELECT 'data:004', len(regexp_extract_all(t, '(?i)\\x02und\\x03')) FROM m
        UNION ALL SELECT 'data:005', len(regexp_extract_all(t, '(?i)\\x02que\\x03')) FROM m)
        SELECT rule, sum(n)::BIGINT AS hits, count(*) AS documents FROM h WHERE n > 0 GROUP BY 1""",
    **{f"x1{x}_{k}": _planted_sql(n) for x, k, n in (
        ("b", "vocabulary", "vocabulary"), ("c", "polite", "polite"), ("d", "shorthand", "shorthand"),
        ("e", "output", "output"), ("f", "paraphrase", "paraphrase"))},
    "x1a_hedges": f"""WITH a AS (SELECT doc_id, regexp_replace(text, '{_FILLERS}', '', 'gi') AS t FROM documents),
        b AS (SELECT doc_id, {q.unmark("regexp_replace(" + q.mark_words("t") + ", '" + _TO_BE + "', '', 'gi')")} AS t FROM a)
        SELECT doc_id, {_tidy('t')} AS text_out FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ', well.'
        WHEN 1 THEN 'Here it is. ' ELSE 'We agree; the point' END || ' ' || t AS t FROM b)""",
    "x1g_custom_rule_groups": """SELECT CASE n_nationkey % 3 WHEN 0 THEN 'language:' || CASE WHEN n_nationkey % 2 = 0 THEN 'de' ELSE 'en' END
        WHEN 1 THEN 'programming:' || CASE WHEN n_nationkey % 4 = 1 THEN 'python' ELSE 'generic' END ELSE 'custom' END AS rule_group,
        count(*) AS rules, count(*) FILTER (n_nationkey % 5 <> 4) AS active_rules FROM nation
        WHERE n_nationkey % 4 = 1 OR n_nationkey % 10 = 0 GROUP BY 1""",
    "x2_stop_words": f"SELECT doc_id, {q.stop_filter('text', [w for w in ALL_STOP if w != 'that'])} AS text_out FROM documents",
    "x2b_stop_words_flat": f"SELECT doc_id, {q.flat_filter('text', vocab.FLAT_STOP_WORDS)} AS text_out FROM documents",
    "x2c_light_words": "SELECT doc_id, " + q.join("list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1'||chr(1), 'g'), chr(1)), lambda s: "
        + q.let(q.words("s"), "ws", "CASE WHEN len(ws) <= 5 THEN s ELSE " + q.join(
            "list_filter(ws, lambda w, i: i = 1 OR i = len(ws) OR regexp_matches(w, '^\\p{Lu}') OR regexp_matches(w, '\\p{N}') "
            f"OR lower(regexp_replace(w, '[^\\p{{L}}\\p{{N}}_]', '', 'g')) NOT IN ({q.quoted(vocab.WEIGHT_STOP_WORDS)}))") + " END") + ")")
        + " AS text_out FROM documents",
    "x3_redundant_sentences": f"""WITH {_redundant(_SENT, _W, 0.55, True)}
        SELECT d.doc_id, CASE WHEN n <= 2 THEN d.text ELSE coalesce(t, '') END AS text_out FROM documents d
        JOIN (SELECT sent.doc_id, any_value(n) AS n, string_agg(s, ' ' ORDER BY sent.pos) FILTER (acc.pos IS NOT NULL) AS t
              FROM sent LEFT JOIN acc ON acc.doc_id = sent.doc_id AND acc.pos = sent.pos GROUP BY 1) k ON k.doc_id = d.doc_id""",
    "x3b_redundant_plain": f"""WITH {_redundant(_PLAIN, 'list_sort(list_distinct(' + q.terms('s') + '))', 0.7, False)}
        SELECT f.doc_id, coalesce(string_agg(s, ' ' ORDER BY f.pos) FILTER (acc.pos IS NOT NULL OR len(w) = 0), '') AS text_out
        FROM feat f LEFT JOIN acc ON acc.doc_id = f.doc_id AND acc.pos = f.pos GROUP BY 1""",
    "x3c_first_sentences": f"""SELECT s AS sentence, arg_min(doc_id, (doc_id, pos)) AS doc_id, arg_min(pos, (doc_id, pos))::INT AS pos,
        count(*) AS uses FROM ({_SENT}) GROUP BY s""",
    "x3c_corpus_sentence_dedup": f"""WITH x AS ({_SENT}), y AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) AS rn FROM x)
        SELECT d.doc_id, coalesce(string_agg(s, ' ' ORDER BY pos) FILTER (rn = 1), '') AS text_out
        FROM documents d LEFT JOIN y ON y.doc_id = d.doc_id GROUP BY d.doc_id""",
    "x3c_near_copies": f"""WITH sets AS (SELECT doc_id, list_sort(list_distinct({q.terms('text', 3)})) AS ws FROM documents),
        g AS (SELECT *, min(doc_id) OVER (PARTITION BY ws) AS original FROM sets WHERE len(ws) > 0),
        reps AS (SELECT * FROM g WHERE original = doc_id),
        wd AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w FROM reps),
        sim AS (SELECT a.doc_id, b.doc_id AS original, round(count(*) / (any_value(a.n) + any_value(b.n) - count(*)), 6) AS similarity
                FROM wd a JOIN wd b ON a.w = b.w AND a.doc_id > b.doc_id GROUP BY a.doc_id, b.doc_id)
        SELECT doc_id, original, 1.0::DOUBLE AS similarity FROM g WHERE original <> doc_id UNION ALL
        SELECT doc_id, arg_max(original, (similarity, -original)), max(similarity) FROM sim WHERE similarity >= 0.7 GROUP BY doc_id""",
    "x4_tfidf": f"""WITH sent AS ({_SENT}),
        occ AS (SELECT doc_id, n, pos, unnest({q.terms('s', 4)}) AS word FROM sent),
        tf AS (SELECT doc_id, n, pos, word, count(*) AS tf FROM occ GROUP BY ALL),
        wt AS (SELECT *, tf * ln((n + 1) / (1 + count(*) OVER (PARTITION BY doc_id, word))) AS w FROM tf),
        sc AS (SELECT s.doc_id, s.n, s.pos, any_value(s.s) AS s, round(coalesce(sum(w), 0) / greatest(1, len({q.words('any_value(s.s)')}))
            * CASE WHEN s.pos = 0 OR s.pos = s.n - 1 THEN 1.8 ELSE 1.0 END::DOUBLE
            * CASE WHEN any_value(s.s) LIKE '%?' THEN 1.5 ELSE 1.0 END::DOUBLE
            * CASE WHEN regexp_matches({q.mark_words('any_value(s.s)')}, '\\x02\\d+\\x03') THEN 1.2 ELSE 1.0 END::DOUBLE, 9) AS score
            FROM sent s LEFT JOIN wt ON wt.doc_id = s.doc_id AND wt.pos = s.pos GROUP BY s.doc_id, s.n, s.pos),
        rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY (pos = 0 OR pos = n - 1) DESC, score DESC, pos DESC) AS rk FROM sc)
        {_rebuild('SELECT * FROM rk', 'rk <= greatest(2, floor(n * 0.35::DOUBLE))', 'n <= 2')}""",
    "x4b_tfidf_plain": f"""WITH sent AS ({_PLAIN}),
        occ AS (SELECT doc_id, n, pos, word FROM (SELECT doc_id, n, pos, unnest({q.terms('s')}) AS word FROM sent) WHERE word NOT IN ({q.quoted(vocab.RANK_STOP_WORDS)})),
        tf AS (SELECT doc_id, n, pos, word, count(*) AS tf FROM occ GROUP BY ALL),
        wt AS (SELECT *, tf * tf * ln(n / (1 + count(*) OVER (PARTITION BY doc_id, word))) AS w FROM tf),
        sc AS (SELECT s.doc_id, s.n, s.pos, any_value(s.s) AS s, round(coalesce(sum(w), 0) / greatest(1, coalesce(sum(tf), 0)), 9) AS score
            FROM sent s LEFT JOIN wt ON wt.doc_id = s.doc_id AND wt.pos = s.pos GROUP BY s.doc_id, s.n, s.pos),
        rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos DESC) AS rk FROM sc)
        {_rebuild('SELECT * FROM rk', 'rk <= greatest(1, floor(n * 0.4::DOUBLE))', 'n <= 2')}""",
    "x4c_corpus_tfidf": f"""WITH sent AS ({_SENT}),
        idf AS (SELECT word, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS idf FROM
            (SELECT unnest(list_distinct({q.terms('text', 4)})) AS word FROM documents) GROUP BY word),
        occ AS (SELECT doc_id, pos, greatest(1, len({q.words('s')})) AS wc, unnest({q.terms('s', 4)}) AS word FROM sent),
        sc AS (SELECT doc_id, pos, round(sum(idf) / any_value(wc), 6) AS score FROM occ JOIN idf USING (word) GROUP BY 1, 2)
        SELECT doc_id, pos::INT AS pos, score, rk::INT AS rk FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rk FROM sc) WHERE rk <= 2""",
    "x5_signal": f"""WITH sc AS (SELECT *, len(list_intersect(list_transform(regexp_extract_all({q.mark_words('lower(s)')}, '\\x02[a-z]+\\x03'),
            lambda w: w[2:-2]), [{q.quoted(KEYWORDS)}])) AS sc FROM ({_SENT})),
        cut AS (SELECT doc_id, n, greatest(1, list_sort(list(sc))[n // 2 + 1]) AS cutoff FROM sc GROUP BY 1, 2),
        kept AS (SELECT doc_id, s, min(pos) AS pos FROM sc JOIN cut USING (doc_id, n) WHERE sc >= cutoff OR pos = 0 OR pos = n - 1 GROUP BY 1, 2)
        SELECT d.doc_id, CASE WHEN any_value(n) <= 2 THEN any_value(d.text) ELSE string_agg(s, ' ' ORDER BY pos) END AS text_out
        FROM documents d JOIN cut USING (doc_id) JOIN kept USING (doc_id) GROUP BY 1""",
    "x5b_signal_substring": f"""WITH x AS (SELECT *, len({q.words('s')}) > 5 AND ({" OR ".join(f"contains(lower(s), '{w}')" for w in SIGNALS)}) AS hit FROM ({_PLAIN}))
        SELECT doc_id, coalesce(string_agg(s, ' ' ORDER BY pos) FILTER (hit), string_agg(s, ' ' ORDER BY pos) FILTER (pos < greatest(1, n // 2))) AS text_out
        FROM x GROUP BY doc_id""",
    "x5c_cluster_profile": "WITH w AS (SELECT lang, unnest(" + q.terms("text") + ") AS w FROM documents) SELECT lang, "
        + ", ".join(f"count(*) FILTER (w IN ({q.quoted(ws)})) AS {c}" for c, ws in CLUSTERS.items())
        + f" FROM w WHERE w IN ({q.quoted(KEYWORDS)}) GROUP BY lang",
    "x6_condense": f"""WITH flat AS (SELECT doc_id, {_FLATTENED} AS text FROM documents),
        wc AS (SELECT doc_id, len({q.words('text')}) AS wc FROM flat),
        sent AS ({q.sentence_rows(source='flat')}),
        occ AS (SELECT doc_id, n, pos, unnest({q.terms('s', 4)}) AS word FROM sent),
        wt AS (SELECT *, count(*) OVER (PARTITION BY doc_id, word) AS f FROM occ),
        ss AS (SELECT doc_id, pos, sum(f / n * ln(n / f)) / count(*) AS raw FROM wt GROUP BY 1, 2),
        rk AS (SELECT s.*, wc, row_number() OVER (PARTITION BY s.doc_id ORDER BY (s.pos = 0) DESC, round(coalesce(raw, 0), 9) DESC, s.pos) AS rk
            FROM sent s JOIN wc USING (doc_id) LEFT JOIN ss ON ss.doc_id = s.doc_id AND ss.pos = s.pos)
        {_rebuild('SELECT * FROM rk', 'rk <= least(greatest(2, wc // 50), n - 1)', 'n <= 2 OR (SELECT wc FROM wc WHERE wc.doc_id = d.doc_id) < 60')}""",
    "x6b_blocks": f"SELECT doc_id, {_MATRIX_BLOCKS} AS text_out FROM (SELECT doc_id, {q.words('text')} AS ws FROM documents)",
    "x7_anchored": f"""WITH x AS (SELECT *, {_ANCHOR_ANY} AS hit FROM ({_SENT})),
        k AS (SELECT doc_id, any_value(n) AS n, count(*) FILTER (hit) AS hits, string_agg(s, ' ' ORDER BY pos) FILTER (hit) AS a,
              string_agg(s, ' ' ORDER BY pos) FILTER (pos < greatest(2, n // 2)) AS b FROM x GROUP BY doc_id)
        SELECT d.doc_id, CASE WHEN n <= 2 THEN text WHEN hits < greatest(2, n // 2) THEN b ELSE a END AS text_out FROM documents d JOIN k USING (doc_id)""",
    "x7b_anchor_inventory": " UNION ALL ".join(
        f"SELECT doc_id, '{k}' AS anchor, len(regexp_extract_all(text, '{v}'))::INT AS hits FROM documents WHERE regexp_matches(text, '{v}')" for k, v in ANCHORS.items()),
    "x10_chunk_table": f"WITH {_CHUNK} SELECT doc_id, pos::INT AS pos, total::INT AS total, md5(chunk) AS chunk_md5 FROM chunk",
    "x10b_chunk_scores": f"WITH {_CHUNK} SELECT doc_id, pos::INT AS pos, round(score, 6) AS score FROM scored",
    "x10_chunk_selection": f"""WITH {_CHUNK}, rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rk FROM scored WHERE total > 2),
        j AS (SELECT doc_id, string_agg('[§' || pos || '] ' || chunk, chr(10) || '---' || chr(10) ORDER BY pos) AS t FROM rk WHERE rk <= 8 GROUP BY 1)
        SELECT p.doc_id, coalesce(t, text) AS text_out FROM para p LEFT JOIN j USING (doc_id)""",
    "m10_a21_stage_rollup": f"""WITH a AS (SELECT lang, text, {q.flat_filter('text', d.DATA_STOP_WORDS)} AS t1 FROM documents),
        b AS (SELECT lang, text, t1, {_MATRIX_BLOCKS} AS t2 FROM (SELECT *, {q.words('t1')} AS ws FROM a)),
        l AS (SELECT lang, 'flat' AS stage, greatest(0, {q.tokens('text')} - {q.tokens('t1')}) AS r FROM b UNION ALL
              SELECT lang, 'blocks', greatest(0, {q.tokens('t1')} - {q.tokens('t2')}) FROM b)
        SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, CASE WHEN grouping(stage) = 1 THEN 'all' ELSE stage END AS stage,
        sum(r)::BIGINT AS tokens_removed, count(*) AS "rows" FROM l GROUP BY ROLLUP (lang, stage)""",
    "x18_request_report": f"""WITH x AS (SELECT doc_id, {q.trim('text')} AS text FROM documents),
        y AS (SELECT doc_id, text, {_MATRIX_BLOCKS} AS o FROM (SELECT *, {q.words('text')} AS ws FROM x)),
        z AS (SELECT *, {q.tokens('text')} AS t0, {q.tokens('o')} AS t1, list_filter([{q.quoted(vocab.TIER_SIGNALS)}], lambda k: contains(lower(o), k)) AS sig FROM y)
        SELECT doc_id, 1 AS step, 'input' AS name, 'success' AS status, len({q.words('text')}) || ' words / ~' || t0 || ' tokens' AS details, t0::DOUBLE AS value FROM z
        UNION ALL SELECT doc_id, 2, 'compression', 'success', t0 || ' -> ' || t1 || ' tokens', {q.pct('t0', 't1')} FROM z
        UNION ALL SELECT doc_id, 3, 'routing', CASE WHEN t1 > 500 OR len(sig) > 0 THEN 'warning' ELSE 'success' END,
          CASE WHEN t1 > 500 THEN 'Token count ' || t1 || ' > threshold 500' WHEN len(sig) > 0 THEN 'Complexity signals: [''' || array_to_string(sig, ''', ''') || ''']'
          ELSE 'None — standard routing' END, (CASE WHEN t1 > 500 OR len(sig) > 0 THEN 2 ELSE 1 END)::DOUBLE FROM z
        UNION ALL SELECT doc_id, 4, 'dispatch', 'success', CASE WHEN t1 > 500 OR len(sig) > 0 THEN 'Gemini 1.5 Pro' ELSE 'DeepSeek V3' END,
          (t1 * CASE WHEN t1 > 500 OR len(sig) > 0 THEN 0.000002 ELSE 0.0000005 END::DECIMAL(20,10))::DECIMAL(20,6)::DOUBLE FROM z""",
}
SQL["x3_any_length"] = SQL["x3_redundant_sentences"]
_ALIASED = "'\\x02[A-Z][a-z]+\\x03(?:\\s+\\x02[A-Z][a-z]+\\x03){1,4}'"


def _alias_sql(source: str) -> str:
    """doc_id, text_out with repeated title-case phrases shortened, first seen first."""
    found = f"list_transform(regexp_extract_all({q.mark_words('text')}, {_ALIASED}), lambda p: {q.unmark('p')})"
    short = ("upper(array_to_string(list_transform(regexp_split_to_array(p, '\\s+')[1:-2], lambda w: w[1:1]), '')) || '-' || "
             "upper(regexp_split_to_array(p, '\\s+')[-1][1:1])")
    return f"""SELECT doc_id, (list_reduce(list_transform(ps, lambda p: {{'t': '', 'p': p, 'a': {short}}}),
        lambda x, y: {{'t': replace(x.t, y.p, y.a), 'p': '', 'a': ''}}, {{'t': text, 'p': '', 'a': ''}})).t AS text_out
        FROM (SELECT doc_id, text, list_filter(f, lambda p, i: list_position(f, p) = i AND len(list_filter(f, lambda z: z = p)) >= 2) AS ps
        FROM (SELECT doc_id, text, {found} AS f FROM {source}))"""


def _shorten_sql(c: str) -> str:
    """The quote rule on one text: code-like text is cut, else sentences are chosen."""
    cut = lambda t: f"CASE WHEN len({q.words(t)}) > 25 THEN array_to_string(({q.words(t)})[1:25], ' ') || ' […]' ELSE {t} END"
    worth = f"(regexp_matches({q.mark_words('y.t')}, '\\x02\\d+\\x03') OR regexp_matches({q.mark_words('y.t')}, '\\x02[A-Z][a-z]{{2,}}\\x03'))"
    pick = f"""(list_reduce(list_transform(ss, lambda s: {{'t': s, 'n': len({q.words('s')})::BIGINT}}),
        lambda x, y: CASE WHEN {worth} AND x.n + y.n <= 50 THEN {{'t': x.t || ' ' || y.t, 'n': x.n + y.n}} ELSE x END)).t"""
    chosen = q.let(pick, "k", cut("k"))
    return (f"CASE WHEN regexp_matches({c}, '[{{}}();=<>]|def |class |import ') OR len({q.sentences(c)}) = 0 THEN {cut(c)} ELSE "
            + q.let(q.sentences(c), "ss", chosen) + " END")


_QUOTELESS = "regexp_replace(text, '[\"'']', '', 'g')"
_DEFAULT_STOP = sorted(set(vocab.STOP_WORDS) - set(vocab.KEEP_WORDS))
_LIGHT = SQL["x2c_light_words"]
_MATRIX_SQL = {
    "stopword": f"SELECT doc_id, {q.stop_filter('text', _DEFAULT_STOP)} AS text_out FROM documents",
    "stopword_flat": SQL["x2b_stop_words_flat"], "light_words": _LIGHT, "redundancy": SQL["x3_redundant_sentences"],
    "redundancy_plain": SQL["x3b_redundant_plain"], "tfidf": SQL["x4_tfidf"], "tfidf_plain": SQL["x4b_tfidf_plain"],
    "chunking": SQL["x6_condense"], "blocks": SQL["x6b_blocks"],
}


def _chain(stages) -> str:
    """Ledger of a chain: each stage's SQL reads the table the stage before made."""
    ctes = ["s0 AS (SELECT doc_id, text FROM documents)"]
    parts = []
    for i, (name, sql) in enumerate(stages, 1):
        ctes.append(f"s{i} AS MATERIALIZED (SELECT doc_id, text_out AS text FROM ({sql.replace('documents', f's{i - 1}')}))")
        parts.append(f"SELECT '{name}' AS stage, {i - 1} AS seq, greatest(0, {q.tokens('a.text')} - {q.tokens('b.text')}) AS r FROM s{i - 1} a JOIN s{i} b USING (doc_id)")
    return (f"WITH {', '.join(ctes)} SELECT stage, seq::INT AS seq, count(*) AS documents, sum(r)::BIGINT AS tokens_removed FROM ("
            + " UNION ALL ".join(parts) + ") GROUP BY 1, 2")


_SAME = "SELECT doc_id, text AS text_out FROM documents"
_HEDGE = f"""SELECT doc_id, {_tidy('t')} AS text_out FROM (SELECT doc_id, {q.unmark("regexp_replace(" + q.mark_words("t") + ", '" + _TO_BE + "', '', 'gi')")} AS t
    FROM (SELECT doc_id, regexp_replace(text, '{_FILLERS}', '', 'gi') AS t FROM documents))"""


def _quote_stage(mark: str) -> str:
    """Quotes of a hundred characters or more, shortened in place."""
    m = mark.replace("'", "''")
    pat = f"'{m}[^{m}]{{100,}}{m}'"
    inner = f"list_transform(f, lambda z: '{m}' || {_shorten_sql('z[2:-2]')} || '{m}')"
    return f"""SELECT doc_id, CASE WHEN len(f) = 0 THEN text ELSE array_to_string(list_transform(g, lambda p, i: p || coalesce(({inner})[i], '')), '') END AS text_out
        FROM (SELECT doc_id, text, regexp_extract_all(text, {pat}) AS f, string_split(regexp_replace(text, {pat}, chr(1), 'g'), chr(1)) AS g FROM documents)"""


SQL |= {
    "x1g_custom_rules": """WITH r AS (SELECT list(lower(substr(n_name, 1, 2)) || '+' ORDER BY n_nationkey) AS ps FROM nation
          WHERE (n_nationkey % 4 = 1 OR n_nationkey % 10 = 0) AND n_nationkey % 5 <> 4)
        SELECT doc_id, (list_reduce(list_transform(ps, lambda p: {'t': '', 'p': p}), lambda x, y: {'t': regexp_replace(x.t, '(?i)' || y.p, '', 'g'), 'p': ''}, {'t': text, 'p': ''})).t AS text_out
        FROM documents, r""",
    "x9_quotes": f"""WITH RECURSIVE x AS (SELECT doc_id, {_QUOTELESS} AS t FROM documents),
        sent AS (SELECT *, len({q.words('s')}) AS wc, regexp_matches({q.mark_words('s')}, '\\x02\\d+\\x03') OR regexp_matches({q.mark_words('s')}, '\\x02[A-Z][a-z]{{2,}}\\x03') AS worth
          FROM ({q.sentence_rows('t', 'x')})),
        walk AS (SELECT doc_id, n, pos, s AS t, wc FROM sent WHERE pos = 0 UNION ALL
          SELECT w.doc_id, w.n, s.pos, CASE WHEN worth AND w.wc + s.wc <= 50 THEN w.t || ' ' || s.s ELSE w.t END, CASE WHEN worth AND w.wc + s.wc <= 50 THEN w.wc + s.wc ELSE w.wc END
          FROM walk w JOIN sent s ON s.doc_id = w.doc_id AND s.pos = w.pos + 1),
        base AS (SELECT x.doc_id, x.t AS whole, CASE WHEN regexp_matches(x.t, '[{{}}();=<>]|def |class |import ') OR walk.t IS NULL THEN x.t ELSE walk.t END AS t
          FROM x LEFT JOIN walk ON walk.doc_id = x.doc_id AND walk.pos = walk.n - 1)
        SELECT doc_id, 'He said "' || CASE WHEN length(whole) < 100 THEN whole WHEN len({q.words('t')}) > 25 THEN array_to_string(({q.words('t')})[1:25], ' ') || ' […]' ELSE t END
          || '" and left, ''ok''.' AS text_out FROM base""",
    "x11_aliases": f"WITH twice AS (SELECT doc_id, text || ' Main Conveyor Motor Temperature and ' || text AS text FROM documents) {_alias_sql('twice')}",
    "x12_standard": _chain([("hedge", _HEDGE), ("quote", _quote_stage("'").replace("documents", "(" + _quote_stage('"').replace("text_out", "text") + ")")),
                            ("stopword", _MATRIX_SQL["stopword"]), ("redundancy", SQL["x3_redundant_sentences"]),
                            ("signal", SQL["x5_signal"].replace(q.quoted(KEYWORDS), q.quoted(sorted({w for ws in vocab.SIGNAL_CLUSTERS.values() for w in ws})))),
                            ("tfidf", SQL["x4_tfidf"])]),
    "x14_weight": _chain([("polite", _SAME), ("shorthand", _SAME), ("light_words", _LIGHT), ("alias", _alias_sql("documents")),
                          ("squeeze", f"SELECT doc_id, {q.trim('regexp_replace(text, $$[\\s]+$$, $$ $$, $$g$$)')} AS text_out FROM documents")]),
    "x17_algorithm_matrix": "WITH " + ", ".join(f"m_{k} AS ({v})" for k, v in _MATRIX_SQL.items()) + ", z AS (" + " UNION ALL ".join(
        f"SELECT '{k}' AS algorithm, {q.tokens('d.text')} AS t0, {q.tokens('m.text_out')} AS t1 FROM documents d JOIN m_{k} m USING (doc_id)" for k in _MATRIX_SQL)
        + f"""), y AS (SELECT *, {q.pct('t0', 't1')} AS pct FROM z)
        SELECT algorithm, count(*) AS documents, sum(t0)::BIGINT AS tokens_before, sum(t1)::BIGINT AS tokens_after, round(avg(pct), 4)::DOUBLE AS avg_pct,
        quantile_disc(pct, 0.5) AS median_pct FROM y GROUP BY 1""",
    "a21_savings_by_class": f"""WITH {AUDIT}, cls AS ({ROUTE_SQL['r1_content_class']})
        SELECT content_type, count(*)::BIGINT AS requests, sum(tokens_original)::BIGINT AS tokens_in, sum(tokens_compressed)::BIGINT AS tokens_out,
        {q.pct('sum(tokens_original)', 'sum(tokens_compressed)')} AS savings_pct FROM audit JOIN cls ON cls.id = audit.doc_id GROUP BY 1""",
}
