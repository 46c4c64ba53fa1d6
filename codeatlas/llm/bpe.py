"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow slices.

The tokenizer is built on the driver from a rank file (token bytes in base64, rank): merges are
recovered from the ranks, bytes are written as the printable characters of the byte table, and
every match of the split pattern is merged separately, once while it is remembered. Its serialised form, bounded by the
vocabulary, travels to the tasks in a broadcast variable. Rows are independent: no shuffle.

``encode`` gives ids as little-endian unsigned 32-bit integers and, if asked, each token's span
of characters; ``decode`` turns ids back into bytes by the reversed byte table. A token may hold
part of a character: bytes are joined before UTF-8 is read, and ``decode_text`` replaces what is
still incomplete by U+FFFD.

Defined results: a null text counts as empty and has no tokens; null ids decode to no bytes; an unknown
id raises. Strings of special tokens are ordinary text. Other columns pass through.
"""

from __future__ import annotations

import base64
import json
import os
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeatlas.llm.arrow import map_slices

#: Characters whose classes no Unicode version changes: texts of these are split by the regex module, which is faster; others by the tokenizer.
SETTLED = re.compile(r"[\x00-\u0557\u2000-\u206f\u3000-\u33ff\u4e00-\u9fa5]*")
#: Pieces that a task remembers at most, besides those of its current slice.
MEMO = 300_000


def byte_table() -> list[str]:
    """A printable character for each byte: itself where printable, else the next one from U+0100."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The last merge that makes ``token``: merge by lower ranks until two parts remain."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts[0], parts[1]


def build_tokenizer(path: str, pattern: str) -> str:
    """The serialised tokenizer for a rank file and a split pattern."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, chars = read_ranks(path), byte_table()
    text = lambda b: "".join(chars[x] for x in b)
    merges = [tuple(map(text, halves(t, ranks))) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
    made = Tokenizer(models.BPE(vocab={text(t): r for t, r in ranks.items()}, merges=merges))
    made.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return made.to_str()


class Pieces(dict):
    """Ids (and offsets) of the pieces of texts, remembered up to a bound."""

    def __init__(self, tokenizer, offsets: bool):
        self.run = tokenizer.encode_batch if offsets else tokenizer.encode_batch_fast
        self.offsets = offsets

    def learn(self, pieces: set[str]) -> None:
        if len(self) > MEMO:
            self.clear()
        new = [p for p in pieces if p not in self]
        for piece, x in zip(new, self.run(new, add_special_tokens=False)):
            ids = np.array(x.ids, "<u4").tobytes()
            self[piece] = (ids, np.array(x.offsets, "<u4").reshape(-1, 2)) if self.offsets else ids


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str], offsets: bool = False) -> DataFrame:
    """``keep`` columns, ``ids`` binary, and with ``offsets`` also ``spans`` binary (start, end in code points).

    The pieces that the pattern finds in an Arrow slice go to the tokenizer once each, as one batch.
    """
    shared = docs.sparkSession.sparkContext.broadcast(build_tokenizer(path, pattern))

    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        single, find, cut = Tokenizer.from_str(shared.value), regex.compile(pattern), Tokenizer.from_str(shared.value).pre_tokenizer
        single.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        known = Pieces(single, offsets)

        def split(text):
            if SETTLED.fullmatch(text):
                return find.findall(text)
            return [text[a:b] for _, (a, b) in cut.pre_tokenize_str(text)]

        def spans(pieces):
            starts = np.cumsum([0, *map(len, pieces[:-1])])
            return b"".join((known[p][1] + s).astype("<u4").tobytes() for p, s in zip(pieces, starts))

        def call(texts):
            found = [split(t or "") for t in texts]
            known.learn(set().union(*found))
            if offsets:
                return [b"".join(known[p][0] for p in pieces) for pieces in found], list(map(spans, found))
            return ([b"".join(map(known.__getitem__, pieces)) for pieces in found],)

        return call

    return map_slices(docs, keep, ["text"], "ids binary" + ", spans binary" * offsets, make)


def decode(encoded: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``decoded`` binary."""
    chars = byte_table()
    back = {c: b for b, c in enumerate(chars)}
    written = {r: "".join(chars[x] for x in t) for t, r in read_ranks(path).items()}
    shared = encoded.sparkSession.sparkContext.broadcast(json.dumps(written))

    def make():
        table = {int(r): bytes(back[c] for c in t) for r, t in json.loads(shared.value).items()}

        def call(ids):
            return ([b"".join(map(table.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in ids],)

        return call

    return map_slices(encoded, keep, ["ids"], "decoded binary", make)


def decode_text(decoded: DataFrame) -> DataFrame:
    """``decoded`` bytes as text; an incomplete character becomes U+FFFD."""
    return decoded.withColumn("text", F.make_valid_utf8(F.col("decoded").cast("string")))


def report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    ids = encode(docs.select("doc_id", "text"), path, pattern, ["doc_id"])
    both = decode(ids, path, ["doc_id", "ids"])
    return both.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
