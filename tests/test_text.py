import random

import pytest
from pyspark.sql import functions as F

from quillmill.functions import metrics as m
from quillmill.functions import vocab
from quillmill.functions.text import sentences, words
from quillmill.operators import dedup, opcode, quotes, ranking, rules, wordfilter
from quillmill.plans import pipelines as p
from quillmill.plans.registry import REGISTRY, column_operator, register
from tests import brute

EDGE = ["", "   ", "One.", "One two. Three four.", "A b c. A b c. A b c.", "Ore tan mil. Ore tan mil rod! Sea key?",
        "Größe äußert sich. Größe äußert sich nicht. Größe äußert sich nie. Élan vital déjà vu.", "12 34. 5 6 7. 8.",
        "x. y. z. w. v."]


def corpus(seed, n, most=14):
    rng = random.Random(seed)
    return EDGE + [brute.random_text(rng, rng.randint(1, most)) for _ in range(n)]


def test_sentences_and_words(one):
    assert one(sentences, " A b.  C!\nD? e ", "", "no end", "a.b c.") == [["A b.", "C!", "D?", "e"], [], ["no end"], ["a.b c."]]
    assert one(words, "  a  b\tc\n", "") == [["a", "b", "c"], []]


@pytest.mark.parametrize("limit", [0.55, 0.3, 0.4])
def test_redundant_sentences_match_brute_force(docs, texts_of, limit):
    texts = corpus(1, 120)
    got = texts_of(dedup.drop_redundant(docs(*texts), threshold=limit))
    assert got == [brute.redundant(t, limit) for t in texts]


def test_redundant_plain_matches_brute_force(docs, texts_of):
    texts = corpus(2, 120)
    assert texts_of(dedup.drop_redundant_plain(docs(*texts))) == [brute.redundant_plain(t) for t in texts]


def test_tfidf_matches_brute_force(docs, texts_of):
    texts = corpus(3, 120, 20)
    assert texts_of(ranking.rank_tfidf(docs(*texts))) == [brute.tfidf(t) for t in texts]


def test_condenser_matches_brute_force(docs, texts_of):
    texts = corpus(4, 80, 40) + ["- one two three.\n- four five six.\n" * 15, "1. alpha beta gamma.\n2) delta epsilon.\n" * 20]
    assert texts_of(ranking.condense(docs(*texts))) == [brute.condense(t) for t in texts]


def test_chunk_packing_matches_brute_force(docs):
    rng = random.Random(5)
    texts = ["\n\n".join(brute.random_text(rng, rng.randint(1, 12)) for _ in range(rng.randint(1, 30))) for _ in range(25)]
    texts += ["# Head\ntext here\n## Sub\nmore text " * 60]
    rows = ranking.chunk_table(docs(*texts), threshold=0).orderBy("doc_id", "pos").collect()
    for i, t in enumerate(texts):
        assert [r["chunk"] for r in rows if r["doc_id"] == i] == brute.pack(t)


def test_chunk_selection_keeps_order_and_limit(docs, texts_of):
    long = "\n\n".join(f"Part {i} has {'many words ' * 30}" for i in range(14))
    short = "a\n\nb"
    chosen, same = texts_of(ranking.keep_chunks(docs(long, short)))
    marks = [int(x.split("]")[0][2:]) for x in chosen.split("\n---\n")]
    assert len(marks) == 8 and marks == sorted(marks) and marks[0] == 0
    assert same == short


def test_subsequences(docs, texts_of):
    texts = corpus(6, 40)
    for op in (dedup.drop_redundant, ranking.rank_tfidf, ranking.keep_anchored):
        for before, after in zip(texts, texts_of(op(docs(*texts)))):
            it = iter(before.split())
            assert all(w in it for w in after.split())


def test_hedges_and_rule_sets(docs, texts_of, one):
    assert one(rules.remove_hedges, "Sure! I think this works. It is worth noting that A, perhaps, B.") == [
        "this works. A, B."]
    assert one(rules.clean_output, "Of course! We do X in order to win, as stated above.") == ["We do X to win, ."]
    out = texts_of(rules.apply_rules(docs("Meeting notes about the database", "profit and loss, P&L"), rules.DOMAIN))
    assert out == ["[MTG:NOT] about the [DB]", "[P&L], P&L"]
    assert len(rules.DOMAIN) == 54 and len(rules.POLITE) == 14 and len(rules.SHORT) == 22


def test_rule_hits_and_order(docs):
    pair = rules.rule_set("s", [("a+", "b"), ("b", "c")])
    df = rules.apply_rules(docs("aab", "xyz"), pair, with_hits=True).orderBy("doc_id")
    first = df.collect()[0]
    assert first["text_out"] == "cc" and [h["hits"] for h in first["hits"]] == [1, 2]
    totals = {r["rule"]: (r["hits"], r["documents"]) for r in rules.hit_totals(df).collect()}
    assert totals == {"s:001": (1, 1), "s:002": (2, 1)}


def test_word_boundaries_cover_all_scripts(docs, texts_of):
    out = texts_of(rules.apply_rules(docs("déjà db éa à a"), rules.rule_set("s", [("a", "X")], bounded=True)))
    assert out == ["déjà db éa à X"]


def test_stop_words(one):
    assert one(wordfilter.drop_stop_words, "The cat is not on the mat. It is.", "The the", "") == [
        "The cat not mat. It is.", "The the", ""]
    assert one(wordfilter.drop_stop_words_flat, "The cat, and the. dog") == ["cat, dog"]
    assert one(wordfilter.drop_light_words, "We saw the big dog in The house of 3 the end. He is in it.") == [
        "We saw big dog The house 3 end. He is in it."]


def test_aliases(docs, texts_of):
    text = "Main Conveyor Motor Temperature rose. The Main Conveyor Motor Temperature fell."
    # Phrases are cut at five words, and "The Main ..." is another phrase, so plant it at sentence starts.
    text = "Check Main Conveyor Motor Temperature. now Main Conveyor Motor Temperature fell, Acme Corp won."
    text = text.replace("Check ", "check ")
    assert texts_of(wordfilter.alias_entities(docs(text))) == ["check MCM-T. now MCM-T fell, Acme Corp won."]
    rows = wordfilter.alias_table(docs(text)).collect()
    assert [(r["phrase"], r["alias"]) for r in rows] == [("Main Conveyor Motor Temperature", "MCM-T")]


def test_quotes(docs, texts_of):
    long = "Alpha beta gamma. " + "plain words without any name follow here. " * 3 + "Rome had 12 gates."
    code = "def f(x): return {x};" + " y = x" * 30
    short, kept, coded = texts_of(quotes.shorten_quotes(docs(f'He said "{long}" and left.', 'A "short" one', f'"{code}"')))
    assert short == 'He said "Alpha beta gamma. Rome had 12 gates." and left.'
    assert kept == 'A "short" one'
    assert coded == '"' + " ".join(code.split()[:25]) + ' […]"'


def test_opcodes(docs, texts_of):
    texts = {
        "Please summarize the quarterly report for the board. It failed because of rain.":
            "[NEX.NL] [DO:SUMMARIZE(quarterly report board)]. It failed [CAU] of rain.",
        "nothing here": "nothing here",
        "status: ok": "[ST:OK]",
        "What is the capital of France?": "[ASK:capital France]",
        "How do I reset the router?": "[HOW:reset router]",
        "I need to build a small house.": "I need to[DO:BUILD(small house)].",
        "We must call mother.": "[NEED:CALL(mother)].",
        "It took 30 seconds, more than 5x.": "It took [N:30 seconds], [CMP:>5x.]",
        "unless the door is shut.": "[UNLESS:door shut].",
        "The api returned an error 500 today": "[NEX.NL] [SVC:ERR(500)] [T:NOW]",
        "The api returned an error": "[NEX.NL] [SVC:ERR(?)]",
        "a 12 % reduction, yet connection refused": "[NEX.NL] a [Δ:12%], [CON] [ERR:TIMEOUT]",
    }
    assert texts_of(opcode.encode_opcodes(docs(*texts))) == list(texts.values())
    stats = {r["opcode"]: r["uses"] for r in opcode.opcode_stats(opcode.encode_opcodes(docs(*texts))).collect()}
    assert stats["SVC:ERR"] == 2 and stats["CAU"] == 1


def test_signal_filter_and_fallbacks(docs, texts_of):
    text = "Start here. The api cost rose. Nothing at all. Nothing at all. The database error. End."
    assert texts_of(ranking.keep_signal(docs(text))) == ["Start here. The api cost rose. The database error. End."]
    assert texts_of(ranking.keep_signal_substring(docs("a b. c d. e f. g h."))) == ["a b. c d."]
    assert texts_of(ranking.keep_anchored(docs("no. nor. yes. maybe."))) == ["no. nor."]
    assert texts_of(ranking.condense_blocks(docs("One. Two. Three."))) == ["One. Two."]


def test_ledger_invariants(docs):
    texts = corpus(7, 30)
    for stages in (p.STANDARD, p.DENSE, p.WEIGHT):
        rows = p.run_stages(docs(*texts), stages).collect()
        assert len(rows) == len(texts)
        for r in rows:
            removed = [e["tokens_removed"] for e in r["ledger"]]
            assert [e["stage"] for e in r["ledger"]] == [n for n, _ in stages]
            assert min(removed) >= 0 and sum(removed) >= r["tokens_before"] - r["tokens_after"]


def test_registry_and_unknown_algorithm(docs):
    register("shout", column_operator(F.upper), level="custom")
    assert REGISTRY["shout"].level == "custom"
    done = p.run_algorithm(docs("abc"), "shout").collect()[0]
    assert done["text_out"] == "ABC" and done["known"]
    lost = p.run_algorithm(docs("abc"), "no such").collect()[0]
    assert lost["text_out"] == "abc" and not lost["known"]
    steps = p.request_report(docs("some text here"), "no such").orderBy("step").collect()
    assert [s["status"] for s in steps] == ["success", "warning", "success", "success"]
    del REGISTRY["shout"]


def test_content_dispatch(docs):
    code = "import os\n\n\n\ndef f(x):\n    return x  // note\n/* gone */\nconst y = f(1);\n"
    log = "\n".join(f"2024-01-01 10:00:{i:02d} ERROR disk {i} full" for i in range(60))
    rows = p.compress_by_content(docs("Please explain the plan. It is good.", code, log, "  ")).orderBy("doc_id").collect()
    assert [r["pipeline"] for r in rows] == ["prose", "code", "log", "none"]
    assert "gone" not in rows[1]["text_out"] and "// note" not in rows[1]["text_out"]
    assert rows[2]["text_out"].startswith("[LOG_SUMMARY]\nTotal lines: 60") and rows[2]["text_out"].count("•") == 1
    assert rows[3]["text_out"] == "  "


def test_message_arrays(spark):
    marked = f"Use {vocab.EXEMPT_MARKER} please"
    df = spark.createDataFrame([(1, [("system", marked), ("user", "please explain in order to win"), ("user", "")])],
                               "request_id long, messages array<struct<role:string,content:string>>")
    r = p.compress_messages(df).collect()[0]
    assert r["messages"][0]["content"] == marked and r["message_count"] == 3
    assert r["messages"][1]["content"] == "explain to win"
    assert r["total_original_tokens"] == len(marked) // 4 + 7


def test_metrics(one):
    assert one(m.est_tokens, "", "abc", "abcdefgh") == [1, 1, 2]
    assert one(lambda c: m.est_tokens(c, True), "", "abc") == [0, 1]
    assert one(m.mask_key, "fk-1234567890", "short", "", None) == ["fk-123...7890", "short", "N/A", "N/A"]
    assert one(m.preview, "x" * 700, "y")[0] == "x" * 600 + "…"
    assert one(m.byte_volume, "é")[0] == 2


def test_corpus_dedup_and_near_copies(docs, texts_of):
    a, b = "Alpha beta gamma.", "Delta epsilon zeta."
    assert texts_of(dedup.dedup_sentences(docs(f"{a} {b}", f"{b} New one here.", a))) == [f"{a} {b}", "New one here.", ""]
    base = [f"word{i}" for i in range(60)]
    near = " ".join(base[:58] + ["other", "words"])
    far = " ".join(f"thing{i}" for i in range(60))
    got = {r["doc_id"]: (r["original"], r["similarity"]) for r in dedup.near_copies(docs(
        " ".join(base), far, " ".join(reversed(base)), near)).collect()}
    assert got[2] == (0, 1.0) and 1 not in got
    assert got[3][0] == 0 and got[3][1] == round(58 / 62, 6)


def test_every_planted_near_copy_is_found(spark):
    """400 pairs of Jaccard 0.739, and two copies that share words with an unrelated first document."""
    rows = []
    for i in range(400):
        base = [f"p{i}word{j}" for j in range(85)] + [f"common{j}" for j in range(15)]
        rows += [(i, " ".join(base)), (1000 + i, " ".join(base[15:] + [f"q{i}word{j}" for j in range(15)]))]
    got = {r["doc_id"]: (r["original"], r["similarity"]) for r in dedup.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1000 + i: (i, round(85 / 115, 6)) for i in range(400)}
