"""Ranking, embedding and derived sources inside the row: no word or trigram becomes a row, results as by plain counting."""

import hashlib
import math
import re

import numpy as np
import pyarrow as pa

from quillmill.operators import dedup, promptcache, ranking
from quillmill.sources import derived

TEXT = "The green house stands. Some green trees stand near water? Water flows 12 miles. Nothing else. The green water house."


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranked_jobs_do_not_explode(docs):
    for op in (ranking.rank_tfidf, ranking.rank_tfidf_plain, ranking.condense):
        text = plan(op(docs(TEXT)))
        assert "Generate" not in text and "Window" not in text and "Aggregate" not in text


def test_tfidf_equals_plain_counting(docs, texts_of):
    ss = re.split(r"(?<=[.!?])\s+", TEXT)
    tokens = [re.findall(r"\w{4,}", s.lower()) for s in ss]
    n = len(ss)

    def score(i):
        raw = sum(math.log((n + 1) / (sum(w in t for t in tokens) + 1)) for w in tokens[i])
        return (raw / len(ss[i].split()) * (1.8 if i in (0, n - 1) else 1.0) * (1.5 if ss[i].endswith("?") else 1.0)
                * (1.2 if re.search(r"\b\d+\b", ss[i]) else 1.0))

    best = sorted(range(n), key=lambda i: (i not in (0, n - 1), -round(score(i), 9), -i))[:3]
    got = texts_of(ranking.rank_tfidf(docs(TEXT, None, "", "One. Two."), keep=0.6))
    assert got == [" ".join(ss[i] for i in sorted(best)), None, "", "One. Two."]


def test_word_weights_of_rows_without_words(spark):
    raw = ranking.word_weights(lambda n, df, f, tf: n * 100.0 + df * 10 + f + tf / 10)
    rows = [(0, [[1, 1], [], [1, 2]]), (1, []), (2, [[]]), (3, [[7]])]
    df = spark.createDataFrame(rows, "i long, h array<array<bigint>>").coalesce(1)
    got = {r["i"]: [round(x, 6) for x in r["w"]] for r in df.select("i", raw("h").alias("w")).collect()}
    assert got == {0: [2 * 323.2, 0.0, 323.1 + 311.1], 1: [], 2: [0.0], 3: [111.1]}


def test_corpus_ranking_groups_sentences_only(docs):
    df = docs("alpha beta alpha. gamma delta.", "alpha gamma. beta beta beta beta.")
    text = ranking.rank_by_corpus(df)._jdf.queryExecution().optimizedPlan().toString()
    # The word is grouped for the word table alone.
    assert sum("word" in x.split("Aggregate [")[1].split("]")[0] for x in text.splitlines() if "Aggregate [" in x) == 1


def test_embedding_counts_in_the_row(spark):
    rows = [(1, "Hello hello"), (1, "other"), (2, None), (3, "ab"), (4, "a\U0001f600bc")]
    df = spark.createDataFrame(rows, "k long, t string")
    sums = {k: [0] * 128 for k, _ in rows}
    for k, t in rows:
        t = (t or "").lower()
        grams = [t[i:i + 3] for i in range(len(t) - 2)] + ["?" + t[i + 1:i + 3] for i in range(len(t) - 2) if t[i] > "￿"]
        for g in grams:
            number = int(hashlib.md5(g.encode()).hexdigest()[:5], 16)
            sums[k][number // 2 % 128] += 1 if number % 2 == 0 else -1
    made = promptcache.embed(df, "k", "t")
    got = {r["k"]: r["embedding"] for r in made.collect()}
    for k, v in sums.items():
        norm = math.sqrt(sum(x * x for x in v))
        assert np.allclose(got[k], [x / norm if norm else 0.0 for x in v], atol=1e-12)
    assert "regexp_extract_all" not in plan(made)  # no trigram is made to explode


def test_redundancy_reads_views_of_the_batch():
    sets = pa.array([[[1, 2], []], [], [[3]]], pa.list_(pa.list_(pa.int64())))
    for cut in (sets, sets.slice(1)):
        assert [[w.tolist() for w in doc] for doc in dedup._rows(cut)] == cut.to_pylist()


def test_plain_redundancy_of_null_text(docs, texts_of):
    """It failed in the Python worker before."""
    assert texts_of(dedup.drop_redundant_plain(docs(None, "", "a b. a b. c"))) == [None, "", "a b. c"]


def test_sources_by_one_pattern(spark, tmp_path):
    texts = ["One two, three four. five! Six", None, "12 $1 .", "  Don't stop\n", "xNx X. é a"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    triples = [[("one", "two", "three"), ("four", "x", "x"), ("five", "x", "x"), ("six", "x", "x")], [], [],
               [("don", "t", "stop")], [("xnx", "x", "x"), ("a", "x", "x")]]
    code = derived.code_documents(spark, str(tmp_path))
    block = ("from {1} import {2}\nimport {0}\n\n\n\ndef {0}({1}):   \n    # {2}\n    url = 'http://{0}'  // link\n    value = {1}\n"
             "    return value\n        {2}()\n    pass\n")
    assert [r["text"] for r in code.orderBy("doc_id").collect()] == ["".join(block.format(*w) for w in ws) for ws in triples]
    assert "lambda" not in plan(code)
    frame = '  File "/srv/{0}/{1}.py", line {3}, in {2}\n'
    traces = derived.traceback_documents(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r["text"] for r in traces] == [
        "Traceback (most recent call last):\n" + "".join(frame.format(*w, i + 1) for i, w in enumerate(ws))
        + "ValueError: " + (ws[0][0] if ws else "") for ws in triples]
