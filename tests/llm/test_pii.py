"""Personal data: base spans by the stated patterns, EM by simulation, planted spans."""

import random
import re

from quillmill.llm import pii as P


def luhn(d):
    return sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def plain(text):
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            spans.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def test_base_spans():
    draw = random.Random(1)
    parts = ["a@b.c", "@", "a.b%", "x", "é", ".", "..", "-", " ", "1.2.3.4", "256", "00", "007", "4111111111111111", "4111 1111-1111 1111",
             "+1 (487) 555-7209", "+", "12", "٣", "\n", "@d.e", "5500005555555559", "(", ")"]
    for _ in range(6000):
        t = "".join(draw.choice(parts) for _ in range(draw.randint(0, 9)))
        assert sorted(P.base_spans(t)) == plain(t), repr(t)


def test_long_runs_take_linear_time():
    import time

    start = time.time()
    for t in ("a" * 300_000 + "@", "1" * 300_000, "1." * 100_000, "+1" + " " * 200_000, "1 " * 150_000, "A" * 100_000, "Ab " * 60_000):
        P.replaced(t, {})
    assert time.time() - start < 30


def test_em_finds_the_reliable_labelers():
    draw = random.Random(2)
    hit, false = (0.9, 0.6, 0.8), (0.05, 0.3, 0.02)
    counts = {}
    for _ in range(20_000):
        true = draw.random() < 0.3
        v = [int(draw.random() < (hit if true else false)[k]) for k in range(3)]
        code = sum(x * 3 ** k for k, x in enumerate(v))
        counts[code] = counts.get(code, 0) + 1
    share, rates, post = P.reliabilities(counts)
    assert abs(share - 0.3) < 0.03
    for k in range(3):
        assert abs(rates[k, 0] - hit[k]) < 0.05 and abs(rates[k, 1] - false[k]) < 0.05
    assert post[1 + 3 + 9] > 0.95 > 0.05 > post[0]


def planted():
    clean = "The river ran along the bank. It was 12 miles long in 1999, and cost 3.50. See page 12-14."
    found = ["Call phone 212-555-0147 now.", "Dear Maria Lopez, hello.", "IBAN DE44 5001 0517 5407 3249 31 please.", "mail a.b@c.example now"]
    return [(i, (found[i % 5] if i % 5 < 4 else clean) + f" Text {i} goes on here.") for i in range(200)]


def test_rows_and_masking(spark):
    rows = planted() + [(900, None), (901, ""), (None, "no data"), (901, "")]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, spans string, n_chars long")
    got = {}
    for r in P.find_personal_data(df).collect():
        got.setdefault(r.doc_id, r)
    kinds = {i: {s.split(":")[0] for s in got[i].spans.split(",") if s} for i in got}
    assert [kinds[i] for i in range(5)] == [{"number"}, {"name"}, {"account"}, {"email"}, set()]
    assert [got[i].spans for i in (900, 901, None)] == [""] * 3 and got[3].n_email == 1
    masked = {r.doc_id: r for r in P.masked(df).collect()}
    assert "[number]" in masked[0].text and "[email]" in masked[3].text and masked[4].text == rows[4][1]
    assert masked[900].text is None and masked[900].n_chars is None and masked[3].n_chars == len(masked[3].text)
    assert P.masked(df).columns == df.columns
    assert P.find_personal_data(df.limit(0)).count() == 0 and P.masked(df.limit(0)).count() == 0


def test_overlapping_spans_are_joined():
    t = "card 4111111111111111 and +4111111111111 end"
    assert P.replaced(t, {}) == "card [card] and [phone] end"


def test_names_of_all_letters_and_numbers_without_context(spark):
    names = ["Herr Jürgen Müller kam.", "Madame Hélène Dupont, oui.", "Dear María López, hola.", "Mr J. R. Tolkien wrote.", "Frau Anna-Lena Groß-Weber sagt.",
             "Dear Maria Elena Lopez, hello.", "Mrs Sinéad O'Neill said.", "Herr Łukasz von der Heide kam.", "Dear Жанна Петрова, hi.", "Dear Zoe\u0301 Garci\u0301a, hi."]
    numbers = ["123-45-6789", "646-555-0147", "030 1234 5678", "06 12 34 56 78"]
    clean = ["The river ran along the bank. It was 12 miles long in 1999, and cost 3.50. See page 12-14.",
             "The United States and New York. Der Große Garten am Alten Fluss, 2024-01-05, 12 34 boats.", "Éric Rohmer Straße ist lang. Size 10-20-30 or 15.30."]
    texts = planted() + [(1000 + i, t) for i, t in enumerate(names * 5)] + [(2000 + i, f"and {n} here") for i, n in enumerate(numbers * 5)]
    texts += [(3000 + i, t) for i, t in enumerate(clean * 20)]
    got = {r.doc_id: r.text for r in P.masked(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    titles = ("Herr", "Madame", "Dear", "Mr", "Frau", "Mrs")
    for i, t in enumerate(names):
        assert got[1000 + i].startswith(tuple(f"{x} [name]" for x in titles)) and len(got[1000 + i].split()) <= 4, (t, got[1000 + i])
    assert [got[2000 + i] for i in range(4)] == ["and [number] here"] * 4
    assert [got[3000 + i] for i in range(3)] == clean
