"""The pipeline stage by stage against plain restatements, on a whole small table."""

import hashlib

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from quillmill.llm import mixing, pii, toxicity  # noqa: E402
from tests.llm.test_neardup import fives  # noqa: E402

SF = "/root/testdata/sf0.01"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    extra = [(90_000, None, None, None, None), (90_001, "", "en", "src1", 0), (90_002, "Same words here today.", "en", None, 22),
             (90_003, "Same words here today.", "en", None, 22), (90_003, "Same words here today.", "en", None, 22), (None, "no id at all", "en", "src1", 12)]
    base = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 400")
    return base.unionByName(spark.createDataFrame(extra, base.schema)).cache()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_order_and_shape():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "pii", "mixing", "bpe"]


def test_toxicity_drops_what_the_score_rejects(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rejected = {r.doc_id for r in toxicity.score_toxicity(docs, labels).where("predicted = 1").collect()}
    got = STAGES["toxicity"](spark, docs, SF)
    assert got.columns == docs.columns
    assert rows(got) == [r for r in rows(docs) if r[0] not in rejected]


def test_one_document_of_each_group_stays(spark, docs):
    """The rule of the stage: five-word strings, Jaccard similarity of 0.8 or more; of texts the least id, null last."""
    got = STAGES["simhash_near_dedup"](spark, docs, SF)
    assert got.columns == docs.columns
    every = docs.collect()
    one = {}  # a number for each text, so that texts meet as in the brute force
    for r in every:
        one.setdefault(r.text or "", len(one))
    root = {i: i for i in one.values()}
    sets = {i: fives(t) for t, i in one.items()}
    for i in root:
        for j in root:
            if i < j and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                x, y = (next(z for z in walk(root, k)) for k in (i, j))
                root[max(x, y)] = min(x, y)
    least = {}
    for r in every:
        g = next(walk(root, one[r.text or ""]))
        if r.doc_id is not None:
            least[g] = min(least.get(g, r.doc_id), r.doc_id)
        else:
            least.setdefault(g, 1 << 62)
    want = sorted((x if x < 1 << 62 else None for x in least.values()), key=repr)
    assert sorted((r.doc_id for r in got.collect()), key=repr) == want


def walk(root, i):
    while root[i] != i:
        i = root[i]
    yield i


def test_masking_changes_only_spans(spark, docs):
    got = STAGES["pii"](spark, docs, SF)
    assert got.columns == docs.columns and got.count() == docs.count()
    for a, b in zip(rows(docs.select("doc_id", "text").dropDuplicates(["doc_id"])), rows(got.select("doc_id", "text").dropDuplicates(["doc_id"]))):
        if a[1] is None or not pii.base_spans(a[1]):
            assert a == b
        else:
            assert not pii.base_spans(b[1])


def test_mixing_takes_what_the_report_says(spark, docs):
    got = STAGES["mixing"](spark, docs, SF)
    assert got.columns == docs.columns
    count = {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.sum(F.size(F.split(F.trim("text"), r"\s+"))).alias("n")).collect()}
    want = {}
    for r in mixing.mix_report(docs).collect():
        if r.taken:
            want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert count == want
    assert all(r.n_chars == len(r.text) for r in got.collect())


def test_tokens_equal_the_library(spark, docs):
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in STAGES["bpe"](spark, docs, SF).collect():
        ids = t.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids) == (len(ids), " ".join(map(str, ids)))
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_every_stage_takes_an_empty_table(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_the_whole_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert set(got.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"} and got.count() > 0
