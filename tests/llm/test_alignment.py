import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from codeatlas.llm import alignment as al
from codeatlas.llm.bpe import byte_table
from tests.conftest import SMALL

A, B, P = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def plain():
    """Token ids and bytes of a whole text by both tokenizers; ([], []) if they do not give the text back."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    back = {c: n for n, c in enumerate(byte_table())}

    def both(text):
        if not text:
            return [], []
        left = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        piece = lambda i: bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
        right = [(i, piece(i)) for i in b.encode(text)]
        return (left, right) if b"".join(x for _, x in left) == b"".join(x for _, x in right) == (" " + text).encode() else ([], [])

    return both


def brute(rows, both):
    docs, held, out = [], Counter(), []
    for doc_id, text in rows:
        a, b = both(text)
        links, spans = [], []
        for side in (a, b):
            at, found = 0, []
            for _, raw in side:
                found.append((at, at + len(raw)))
                at += len(raw)
            spans.append(found)
        groups, i, j = [], 0, 0
        first = 0
        for x, (s, e) in enumerate(spans[0]):
            while first < len(spans[1]) and spans[1][first][1] <= s:
                first += 1
            y = first
            while y < len(spans[1]) and spans[1][y][0] < e:
                links.append((a[x][0], b[y][0]))
                y += 1
        ends = {e for _, e in spans[0]} & {e for _, e in spans[1]}
        for end in sorted(ends):
            k, m = i, j
            while k < len(a) and spans[0][k][1] <= end:
                k += 1
            while m < len(b) and spans[1][m][1] <= end:
                m += 1
            groups.append(",".join(str(t) for t, _ in a[i:k]) + "|" + ",".join(str(t) for t, _ in b[j:m]))
            i, j = k, m
        held.update(set(links))
        docs.append((doc_id, len(a), len(b), groups, links))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    for doc_id, n_a, n_b, groups, links in docs:
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), sha256(";".join(groups).encode()).hexdigest() if n_a else ""))
    return Counter(out)


ODD = [
    " ", "  a  ", "\n", "a\n\n b\t\tc \x1c!\x1c? d\x1f", "it's <s> </s> <|endoftext|> <unk> <0x41>", "under▁score", "naïve 日本語 \U0001d4b3　x", "a b c d\x85e", "x" * 3000 + " " * 70 + "y", "\ttab first", " \n mixed \r\n ends \r", "١٢٣ ½ ‍“q”… ﬁ Å Å",
    "the the the", "\x00nul\x00 in", "é a️ ​‍",
]


def test_report_equals_brute_force(spark, odd_docs, no_docs, plain, monkeypatch):
    monkeypatch.setattr(al, "RECORDS", 5000)  # several chunks
    monkeypatch.setattr(al, "FRAME", 64)
    monkeypatch.setattr(al, "PENDING", 128)
    monkeypatch.setattr(al, "BLOCK", 3000)  # long texts block by block
    given = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()] + [(100 + i, t) for i, t in enumerate(ODD)] + [(1000 + i, t) for i, t in given] + [(100, "the the"), (100, "the the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = al.report(docs, A, B, P)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 7 + ["string"]
    assert Counter(map(tuple, got.collect())) == brute(rows, plain)
    assert al.report(no_docs, A, B, P).count() == 0


def test_units_give_what_whole_texts_give(plain, monkeypatch):
    """Both vocabularies allow the cuts, and random texts of nasty characters come out alike, in one block or several."""
    tok, r = al.Tokenizers(A, B, P), random.Random(9)
    assert tok.cuts and tok.fast
    alphabet = list(" \n\t\r\x0b\x1c\x85\xa0　 ") + list("ab'sL1.,!?▁é日ı́\U0001f600") + ["the", "  ", "\n\n", "'ll", "123"]
    aligned = al.Aligned(tok)
    for n in range(600):
        monkeypatch.setattr(al, "BLOCK", 12 if n % 2 else 500_000)
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(1, 40)))
        blocks = [(units, aligned.learn(set(units))) for units in tok.units(text)]
        assert "".join(u for units, _ in blocks for u in units) == " " + text
        ((want, *numbers),) = brute([(0, text)], plain)
        found = aligned.document(blocks)
        assert (found is None) == (numbers[0] == 0), text
        assert found is None or (*found[:4], found[4]) == (*numbers[:4], numbers[6]), text


def test_merge_counts_and_finds_the_highest(monkeypatch):
    monkeypatch.setattr(al, "FRAME", 5)
    monkeypatch.setattr(al, "PENDING", 8)
    rng, total, runs = np.random.default_rng(3), Counter(), []
    for _ in range(9):
        keys = np.unique(rng.integers(0, 4, 40).astype(np.uint64) << np.uint64(32) | rng.integers(0, 12, 40).astype(np.uint64))
        held = rng.integers(1, 9, len(keys)).astype(np.uint32)
        total.update(dict(zip(keys.tolist(), held.tolist())))
        runs.append((keys, held))
    most, back = {}, defaultdict(list)
    for kind, x, y, *counts in al.merge([al.run(*r) for r in runs]):
        if kind == "most":
            assert x not in most
            most[x] = y
        else:
            back[x] += [(y, counts[0])]
    for k, (keys, _) in enumerate(runs):
        assert np.concatenate([c for _, c in sorted(back[k], key=lambda f: f[0])]).tolist() == [total[p] for p in keys.tolist()]
    assert most == {a: max(n for p, n in total.items() if p >> 32 == a) for a in {p >> 32 for p in total}}
    assert list(al.merge([])) == []
