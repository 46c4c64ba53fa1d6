import re
import time
from hashlib import sha256

from codeatlas.llm import pii

# The base patterns in their plain form.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def holds(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in v.split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def test_base_matches_plain_search(spark, odd_docs, no_docs):
    texts = [
        "mail a.b@c.d.com, x@y and é z@q.rr.ss 1.2.3.4.5 256.1.1.1 000.001.2.255", "card 4111 1111 1111 1111 then 4111-1111-1111-1112 5 6 7", "+49 (30) 1234-5678 and +1 2", "1 " * 4000,
        "9" * 6000, "\U0001f600 +12 345 678 901 \U0001f600 a@b.cc", "a@b.c_d@e.ff@g.hh", "+1+2345678901 4539578763621486",
    ]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    for r in docs.collect():
        found = sorted((m.start(), n, m.end(), k) for n, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, r.text or "") if holds(k, m[0]))
        named = ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)
        assert got[r.doc_id].base_sha256 == sha256(named.encode()).hexdigest(), r.text[:80]
        assert [got[r.doc_id][f"n_{k}"] for k in BASE] == [sum(f[3] == k for f in found) for k in BASE]
    assert pii.report(no_docs).count() == 0


def test_long_runs_take_time_linear_in_the_text(spark):
    valid = "4539578763621486 "
    texts = [
        ",".join("123456789"[k % 9] for k in range(500_000)), "x" * 1_000_000 + " a@b.cc", "7" * 1_000_000, "1.1.1.1 " * 60_000, valid * 30_000, "a@b.cc," * 60_000, "DE89370400440532013000 " * 20_000, "1 " * 500_000,
        "my ssn 123-45-6789 " * 30_000,
    ]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(len(texts))
    begun = time.time()
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    assert time.time() - begun < 120
    assert [got[0].n_card, got[1].spans, got[2].spans, got[3].n_ip, got[4].n_card, got[5].n_email] == [0, "email:1000001:1000007", "", 60_000, 0, 60_000]
    assert (got[6].spans.count("iban"), got[7].spans, got[8].spans.count("ssn")) == (20_000, "", 30_000)


def test_context_words_raise_the_score(spark):
    rows = [(1, "DE89370400440532013000"), (2, "Konto DE89370400440532013000"), (3, "4539578763621486 is my card"), (4, "host 10.0.0.1, or 10.0.0.2" + " x" * 30 + " 10.0.0.3"), (5, None)]
    got = {r.doc_id: r.scores for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "0.60", 2: "0.90", 3: "1.00", 4: "1.00,1.00,0.70", 5: ""}


def test_columns_of_the_caller_stay(spark):
    docs = spark.createDataFrame([(1, "a@b.cc", "mine", 5)], "doc_id long, text string, spans string, _text int")
    row = pii.detect(docs).first()
    assert (row.spans, row._text, [x.kind for x in row.spans_]) == ("mine", 5, ["email"])


def test_iban_needs_its_checksum_and_ssn_a_context_word(spark):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00 ok"), (2, "IBAN DE88370400440532013000"), (3, "my ssn is 123-45-6789"), (4, "part 123-45-6789")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "iban:5:32", 2: "", 3: "ssn:10:21", 4: ""}


def test_iban_ends_at_its_countrys_length_and_context_may_follow(spark):
    iban, other = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    rows = [
        (1, f"{iban} BIC COBADEFFXXX"), (2, f"pay {iban} EUR 500"), (3, f"{iban} {other} X"), (4, f"AT12 {iban}"), (5, "123-45-6789 (SSN)"), (6, "123-45-6789 " + "x" * 60 + " ssn"),
        (7, "DE88 3704 0044 0532 0130 00 BIC"), (8, f"\U0001f600 {iban.replace(' ', '')} NO93 8601 1117 947 A1"),
    ]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "iban:0:27", 2: "iban:4:31", 3: "iban:0:27,iban:28:55", 4: "iban:5:32", 5: "ssn:0:11", 6: "", 7: "", 8: "iban:2:24,iban:25:43"}
