"""Masking and restoring are exact for any text and any pattern."""

import random

from quillmill.operators import privacy as v


def both(docs, texts, custom=""):
    masked = v.mask(docs(*texts), custom=custom)
    return {r.doc_id: r for r in v.reinject(masked).collect()}


def test_restoring_gives_the_input_back(docs):
    draw = random.Random(1)
    parts = ["a@b.de", "EMAIL", "[EMAIL_1]", "[EMAIL_12]", "[", "]", "_1", "[WORD_1]", "[PLACEHOLDER_1]", "ID 12345", "12345", "2024-01-15",
             "+49 170 1234567", "Anna Schmidt", "Dr. Smith", " ", "\n", "é", "﷐", "﷒x﷑", "$1", "\\1"]
    texts = [None, "", *["".join(draw.choice(parts) + draw.choice(["", " "]) for _ in range(draw.randint(0, 14))) for _ in range(400)]]
    custom = "EMAIL|||WORD\n(?<=ID )\\d+|||NUM\n(a)(b)\\1|||BACK\n[SN]chm[a-z]+|||PART"
    got = both(docs, texts, custom)
    for i, t in enumerate(texts):
        assert got[i].restored == t, repr(t)


def test_the_types_are_those_of_the_alternatives(docs):
    got = both(docs, ["ID 12345 and more", "mail a@b.de and EMAIL here", "aba aab", "on 2024-01-15 call 0049 30 1234567", "Anna Schmidt from Berlin"],
               "(?<=ID )\\d+|||NUM\nEMAIL|||WORD\n(a)(b)\\1|||BACK")
    assert [got[i].clean_content for i in range(5)] == [
        "ID [NUM_1] and more", "mail [EMAIL_1] and [WORD_1] here", "[BACK_1] aab", "on 2024-01-15 call [PHONE_1]", "[NAME_1] from Berlin"]


def test_bad_patterns_are_skipped_and_reported(docs):
    custom = "(?P<a>x)|||A\n(|||B\nword|||C"
    assert v.rejected_patterns(custom) == [("A", "(?P<a>x)"), ("B", "(")]
    assert both(docs, ["a word"], custom)[0].clean_content == "a [C_1]"


def test_many_values_in_one_document(docs):
    text = " ".join(f"user{i}@mail.example" for i in range(100_000))
    got = both(docs, [text])[0]
    assert got.restored == text and len(got.mapping) == 100_000 and got.clean_content.endswith("[EMAIL_100000]")


def test_responses_are_restored_from_texts_searched_once(spark):
    """The answers and the mapping come from one stored table, so no text is read or searched for the second side."""
    from quillmill.suite import guard
    from tests.conftest import SMALL

    plan = guard._responses(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan


def test_kinds_and_values_beside_marks_of_the_text(docs):
    """Texts with noncharacters and texts without an address take other ways and give the same matches."""
    text = "Anna Schmidt, ID-12345 and 10.0.0.1 on 2024-01-15; \ufdd0x\ufdd1 DE12 3456 7890 1234 +49 170 1234567 [EMAIL_3]"
    rows = [[(r.entity_type, r.value) for r in v.detect(docs(t)).orderBy("pos").collect()]
            for t in (text, text.replace("\ufdd0", "").replace("\ufdd1", ""), text + " a@b.de", "ID 1\ufdd02", "Mr Ab\ufdd2 a\ufdd1@b.de")]
    assert rows[0] == rows[1] and rows[2] == [*rows[0], ("EMAIL", "a@b.de")] and [k for k, _ in rows[0]] == ["NAME", "ID", "IP", "IBAN", "PHONE"]
    assert rows[3] == [] and rows[4] == [("NAME", "Mr Ab")]
