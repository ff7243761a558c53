"""Spans against Python's regular expressions, and patterns that bootstrap."""

import hashlib
import re

import pytest

from trailmark.llm import pii

PATTERNS = {"email": pii.EMAIL, "ip": pii.IP, "card": pii.CARD, "phone": pii.PHONE}


def luhn(digits):
    d = [int(c) for c in digits[::-1]]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def holds(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {
        "email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")),
        "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15,
    }[kind]()


def base(text):
    out = [
        (m.start(), i, f"{k}:{m.start()}:{m.end()}")
        for i, k in enumerate(PATTERNS) for m in re.finditer(PATTERNS[k], text or "") if holds(k, m[0])
    ]
    return [x for _, _, x in sorted(out)]


HARD = [
    "a@b.cc%x@d.ee a.b@c x@y.z. ..@a.b-c.d", "1.2.3.4.5.6.7.8 256.1.1.1 0.00.000.1 1.2.3 99999999999.1.1.1 1.2.3.4",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 41111111111111114111111111111111 4 2", "+1 (988) 555-2485 +12 +1234567890123456 ++1 22 333 4444",
    "é😀 +1 (988) 555-2485 é a@b.cc", "x" * 5000 + "@", "1" * 3000, "@" * 50, "4111111111111111 a@b.co", None, "",
    "+1 1.2.3.4 4111 1111 1111 1111", " 4111111111111111", "1-" * 9 + "1", "\n\n5500-0000-0000-0004\n",
]


def test_exact_kinds(spark, docs, rows):
    table = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest(pii.find_personal_data(table)).collect()}
    for i, t in enumerate(HARD):
        want = base(t)
        assert got[i].spans == ",".join(want), t
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (got[i].n_email, got[i].n_ip) == tuple(sum(x.startswith(k) for x in want) for k in ("email", "ip"))
    more = pii.find_personal_data(docs)
    assert more.columns == [*docs.columns, "base", "spans"] and more.count() == len(rows)


def test_patterns_find_unseen_identifiers(spark, no_docs):
    texts = [f"acct: {n}" for n in ("4111111111111111", "5500000000000004", "340000000000009", "4012888888881881", "6011000000000004")]
    texts += ["acct: 4111111111111112 here", "version: 4111111111111112", "order 99999", "acct: none"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(5, texts[5])], "doc_id long, text string")
    found = pii.find_personal_data(table)
    got = {r.doc_id: r for r in pii.digest(found).collect()}
    assert got[5].spans == "card:6:22" and got[5].n_card == 0
    assert [got[i].spans for i in (6, 7, 8)] == ["", "", ""]
    assert {r.text for r in pii.redacted(found).collect()} >= {"acct: <CARD> here", "acct: <CARD>", "order 99999"}
    assert pii.find_personal_data(no_docs).count() == 0


PROSE = {
    "email": ("please write to {} about the invoice", "jane.roe99", "jane at corp dot example", "jane@corp"),
    "ip": ("the server answers on host {} since monday", "10.0.300.7", "2001:db8:0:0:8:800:200c:417a"),
    "card": ("she paid with visa {} last week", "4111 1111 1111 1112", "4111-1111-1111-1112"),
    "phone": ("you can dial {} every morning", "555-867-5309", "(555) 867-5309", "555 867 5309"),
}
SEEDS = {
    "email": [f"u{i}@mail.example.com" for i in range(6)], "ip": [f"10.0.0.{i}" for i in range(6)],
    "card": ["4111111111111111", "5500000000000004", "340000000000009", "4012888888881881", "6011000000000004", "5105105105105100"],
    "phone": [f"+1 (988) 555-248{i}" for i in range(6)],
}


@pytest.mark.parametrize("labelled", [False, True])
def test_each_kind_in_relaxed_forms(spark, labelled):
    texts, want = [], {}
    for kind, (sentence, *unseen) in PROSE.items():
        sentence = f"{kind}: {{}}" if labelled else sentence
        texts += [sentence.format(seed) for seed in SEEDS[kind]]
        for value in unseen:
            at = sentence.index("{")
            want[len(texts)] = f"{kind}:{at}:{at + len(value)}"
            texts.append(sentence.format(value))
    plain = ["of a thing that", "of 555-867-5309 a", "of jane.roe99 a", *["of nothing"] * 30, *[f"of {x} x" for x in SEEDS["phone"]]]
    table = spark.createDataFrame(list(enumerate(texts + plain)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest(pii.find_personal_data(table)).collect()}
    assert {i: got[i].spans for i in want} == want
    assert all(not got[len(texts) + i].spans for i in range(3 + 30))


LONG = {
    "email": ("x@a" + ".a" * 500_000, 1),
    "email dots": ("x@a.b" + "." * 1_000_000, 1),
    "email run": ("x" * 1_000_000 + "@", 0),
    "ip": ("1." * 500_000, 125_000),
    "card": ("4 " * 500_000, 0),
    "card run": ("1-" * 500_000 + "1", 0),
    "phone": ("+1" + "(2) " * 250_000, 0),
    "hidden": ("x [at] a" + " [dot] a" * 125_000, 0),
    "hexadecimal": ("ab:" * 333_333, 0),
    "name": ("a1_" * 333_333, 0),
    "at": ("x at a" + " dot a" * 160_000, 0),
}


def test_very_long_texts_of_each_kind(spark):
    """A million characters of what each form repeats end well; as many matches as there are."""
    rows = [(i, text) for i, (text, _) in enumerate(LONG.values())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["n"] for r in pii.find_exact(docs).selectExpr("doc_id", "size(base) AS n").collect()}
    assert found == {i: n for i, (_, n) in enumerate(LONG.values())}


def test_time_grows_with_the_matches_not_with_their_square(spark):
    import time

    def seconds(n):
        docs = spark.createDataFrame([(1, "mail u1@ab.cd now " * n)], "doc_id long, text string")
        start = time.perf_counter()
        assert pii.find_exact(docs).selectExpr("size(base) AS n").first()["n"] == n
        return time.perf_counter() - start

    seconds(100)
    few, many = min(seconds(4000) for _ in range(2)), min(seconds(16_000) for _ in range(2))
    assert many < 9 * few + 0.5
