import base64
from hashlib import sha256

import numpy as np
import public_tokenizers
import tiktoken

from codeatlas.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_report_equals_plain_encoding(spark, odd_docs, no_docs):
    nasty = [(20, "naïve 日本語 \U0001d4b3 é 　x"), (21, "<|endoftext|> it's  I'LL\r\n\r\n  z"), (22, "a" * 3000 + " " * 70), (23, "١٢٣ ½ ‍“q”…")]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(nasty, "doc_id long, text string"))
    enc = plain()
    want = sorted((str(r.doc_id), len(ids := enc.encode_ordinary(r.text or "")), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256((r.text or "").encode()).hexdigest()) for r in docs.collect())
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.report(docs, PATH, PATTERN).collect())
    assert got == want
    assert bpe.report(no_docs, PATH, PATTERN).count() == 0


def test_offsets_cover_the_text_and_split_characters_decode(spark):
    text = "héllo 日本 \U0001f600!"
    row = bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH, PATTERN, ["doc_id"], offsets=True)
    r = row.first()
    spans = np.frombuffer(r.spans, "<u4").reshape(-1, 2)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and len(spans) == len(r.ids) // 4
    assert all(a[0] <= b[0] for a, b in zip(spans, spans[1:]))
    cut = spark.createDataFrame([(1, r.ids[: -4 * 2])], "doc_id long, ids binary")
    assert text.startswith(bpe.decode_text(bpe.decode(cut, PATH, ["doc_id"])).first().text.rstrip("�"))
