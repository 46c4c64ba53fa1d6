"""Cross-tokenizer alignment with external spill counting.

Each text is encoded by two tokenizers, A on a blank and the text, B on the text (it adds the blank). Byte offsets where tokens of both
end cut them into groups; an A token and a B token whose byte ranges overlap are linked. A pair of ids counts the documents that hold it
linked, and every document gets back what its links' counts come to.

1. A pass over the documents encodes and aligns. Texts fall into units that no token of either crosses (checked against both
   vocabularies), so that a unit's tokens, groups and links are made once while it is remembered. Pair-document records are gathered up to
   ``RECORDS``, put in order of the pair and spilled: a zstd table of the records in this order, and for each radix part of the A ids a zstd
   run of the distinct pairs and their documents, in frames of ``FRAME`` pairs. A chunk of records is one row, a run is one row.
2. Runs are shuffled by their part. A task merges the runs of a part with a heap over the next frames' first pairs: pairs below the
   smallest of these are complete, are counted and their counts go back to the frames that held them. Order is by A id before B id, so the
   highest count of an A id is known when its pairs have passed. Only frames that are open are in memory.
3. Counts return to their chunk, one value for each of its distinct pairs, and meet its records there; the highest counts are one number for each id of
   A's vocabulary and are sent to all tasks. Documents sum their records' counts.

A pair that every document has is one entry in a run and not a row for each document, and a frequent A id is spread over runs and
frames; no task holds all records of a pair.

Defined results: null and empty texts, and texts that the tokens of A or B do not give back byte for byte, have no tokens: zeros and an empty
``groups_sha256``. Rows that repeat an id, and rows without one, are documents of their own. Strings of special tokens are ordinary text. Empty
tables give no rows.
"""

from __future__ import annotations

import heapq
import itertools
import json
import math
import os
import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from codeatlas.llm.arrow import map_slices
from codeatlas.llm.bpe import SETTLED, byte_table
from codeatlas.sources.scratch import durable

RECORDS, FRAME, PENDING = 1_000_000, 4096, 65_536
#: Units that a task remembers, the characters of the longest of them, and the characters that are aligned at once.
MEMO, LONG, BLOCK = 300_000, 64, 500_000
#: A unit ends where a blank or a line feed follows something else than white space.
UNITS = re.compile(r"\s*\S+(?:[^\S \n]\s*(?:\S+|\Z))*|\s+")
#: Bits of a number in the packed ones, and of an id of A.
BITS, ID_BITS = 40, 18
MIX = 40_503  # odd: A ids in another order, so that radix parts are even


class Tokenizers:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        if self.a.get_vocab_size() > 1 << ID_BITS:
            raise ValueError(f"the vocabulary of A has more than 2^{ID_BITS} entries")
        back = {c: n for n, c in enumerate(byte_table())}
        vocabulary, merges = (json.loads(self.a.to_str())["model"][k] for k in ("vocab", "merges"))
        ranks = {bytes(map(back.__getitem__, t)): i for t, i in vocabulary.items() if all(c in back for c in t)}
        made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        #: The same merges in the order of the ids: for texts whose characters both libraries take alike.
        self.fast = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if made == sorted(made) else None
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for raw, i in ranks.items():
            self.bytes_a[i] = raw
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        blank = self.b.piece_to_id("▁")
        self.blank = blank if pieces[blank] == "▁" else None
        crossing = re.compile(r"[^▁]▁|\n")  # a blank after something else, or a line feed
        self.cuts = self.blank is not None and not any(crossing.search(p) for i, p in enumerate(pieces) if not self.b.is_byte(i) and not self.b.is_control(i) and not self.b.is_unknown(i))

    def units(self, text: str):
        """Blocks of parts of a blank and the text that no token crosses."""
        if not self.cuts:
            yield [" " + text]
        elif len(text) <= BLOCK:
            yield UNITS.findall(" " + text)
        else:
            found = (m[0] for m in UNITS.finditer(" " + text))
            while block := list(itertools.islice(found, BLOCK // 4)):
                yield block

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text that begins with the blank (or, further on in a text, with a line feed)."""
        a = self.fast.encode_ordinary(text) if self.fast and SETTLED.fullmatch(text) else self.a.encode(text, add_special_tokens=False).ids
        if text == " ":
            b = [self.blank]  # B adds a blank, but to no empty text
        else:
            b = self.b.encode(text[1:] if text[0] == " " else text, num_threads=1)
            b = b if text[0] == " " else b[1:] if b[:1] == [self.blank] else []
        return np.array(a, np.int64), np.array(b, np.int64)


def mixed(a: np.ndarray) -> np.ndarray:
    """A ids in another order, one to one."""
    return (a.astype(np.uint64) * np.uint64(MIX)) & np.uint64((1 << ID_BITS) - 1)


class Aligned(dict):
    """For each unit: its groups, its pairs (A id mixed << 32 | B id) as bytes, and the numbers of A tokens, B tokens and groups packed in
    one; None if the tokens do not give its bytes back. Remembered up to a bound."""

    def __init__(self, tokenizers: Tokenizers):
        self.tok = tokenizers
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (tokenizers.bytes_a, tokenizers.bytes_b))
        #: What follows an id in the groups' text: a comma, or what ends its side of a group.
        self.marks = [f"{i}{end}" for n, ends in ((len(self.size_a), ",|"), (len(self.size_b), ",;")) for i in range(n) for end in ends]

    def learn(self, units: set[str]) -> dict:
        """The units that are not known; long ones are returned and not kept."""
        if len(self) > MEMO:
            self.clear()
        new, once = [u for u in units if u not in self], {}
        kinds: dict[bool | None, list[str]] = {True: [], False: [], None: []}
        for u in new:  # one after the other they are a text whose tokens are theirs, unless white space meets white space
            kinds[None if u[-1].isspace() or not self.tok.cuts else bool(SETTLED.fullmatch(u))].append(u)
        for kind, some in kinds.items():
            start = size = 0
            for k, u in enumerate(some):
                size += len(u)
                if size > BLOCK or kind is None or k == len(some) - 1:
                    self._align(some[start : k + 1], once)
                    start, size = k + 1, 0
        return once

    def _align(self, units: list[str], once: dict) -> None:
        raw = [u.encode() for u in units]
        a, b = self.tok.encode("".join(units))
        whole = b"".join(raw)
        if b"".join(map(self.tok.bytes_a.__getitem__, a.tolist())) != whole or b"".join(map(self.tok.bytes_b.__getitem__, b.tolist())) != whole:
            for u in units if len(units) > 1 else []:
                self._align([u], once)
            if len(units) == 1:
                (self if len(units[0]) <= LONG else once)[units[0]] = None
            return
        ends_a, ends_b, ends = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]), np.cumsum(list(map(len, raw)))
        cuts = np.union1d(ends_a, ends_b)
        pairs = (mixed(a[np.searchsorted(ends_a, cuts)]) << np.uint64(32) | b[np.searchsorted(ends_b, cuts)].astype(np.uint64)).tobytes()
        last_a, last_b = ends_b[np.searchsorted(ends_b, ends_a)] == ends_a, ends_a[np.searchsorted(ends_a, ends_b)] == ends_b
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        through_a, through_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1  # tokens up to the end of each group
        written = np.empty(len(a) + len(b), np.int64)
        written[np.arange(len(a)) + np.append(0, through_b)[group_a]] = 2 * a + last_a
        written[np.arange(len(b)) + through_a[group_b]] = 2 * (len(self.size_a) + b) + last_b
        text = list(map(self.marks.__getitem__, written.tolist()))
        of = lambda points: np.searchsorted(points, ends, "right")
        n_a, n_b, n_links = of(ends_a), of(ends_b), of(cuts)
        n_groups = of(ends_a[last_a])
        at_a = at_b = at_link = at_group = 0
        for u, i, j, k, g in zip(units, n_a.tolist(), n_b.tolist(), n_links.tolist(), n_groups.tolist()):
            made = "".join(text[at_a + at_b : i + j])[:-1], pairs[8 * at_link : 8 * k], (i - at_a) | (j - at_b) << BITS | (g - at_group) << 2 * BITS
            (self if len(u) <= LONG else once)[u] = made
            at_a, at_b, at_link, at_group = i, j, k, g

    def document(self, blocks):
        """(n_a, n_b, n_groups, n_links, digest, distinct pairs, how often) of a text in blocks of units; None if it has no tokens."""
        digest, packed, n_links, parts = sha256(), 0, 0, []
        for units, once in blocks:
            found = [self[u] if u in self else once[u] for u in units]
            if None in found:
                return None
            text, pairs, sizes = zip(*found)
            digest.update(((";" if packed else "") + ";".join(text)).encode())
            pairs = np.frombuffer(b"".join(pairs), np.uint64)
            packed, n_links = packed + sum(sizes), n_links + len(pairs)
            parts.append(np.unique(pairs, return_counts=True))
        keys, counts = parts[0]
        if len(parts) > 1:
            keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([c for _, c in parts])).astype(np.int64)
        low = (1 << BITS) - 1
        return packed & low, packed >> BITS & low, packed >> 2 * BITS, n_links, digest.hexdigest(), keys, counts


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(x).tobytes() for x in arrays))


def unpack(raw: bytes, kinds: str, sizes: list[int]) -> list[np.ndarray]:
    """Arrays of the given kinds (numpy's names, blank-separated) and sizes."""
    data, at, out = zstandard.ZstdDecompressor().decompress(raw), 0, []
    for kind, n in zip(kinds.split(), sizes, strict=True):
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    return out


def gaps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=keys.dtype.type(0))


class Chunk:
    """Pair-document records until they are spilled."""

    def __init__(self):
        self.keys, self.counts, self.size, self.docs = [], [], 0, 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        self.docs += 1

    def spill(self, part_bits: int):
        """Distinct pairs and records as one row's binary, then (part, run) of each radix part."""
        docs = np.repeat(np.arange(self.docs, dtype=np.uint32), [len(k) for k in self.keys])
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts).astype(np.uint32)
        order = np.argsort(keys, kind="stable")
        keys, docs, counts = keys[order], docs[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        pairs, held = keys[first], np.diff(np.append(first, len(keys))).astype(np.uint32)
        records = np.array([len(pairs), len(keys), self.docs], "<i8").tobytes() + pack(gaps(pairs), held, docs, counts)
        part = (pairs >> np.uint64(32 + ID_BITS - part_bits)).astype(np.int64)
        cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else [0]
        return records, [(int(part[s]), run(pairs[s:e], held[s:e])) for s, e in zip(cuts[:-1], cuts[1:])]


def run(keys: np.ndarray, held: np.ndarray) -> bytes:
    """Sorted pairs and their documents in frames: their number, each one's first pair, pairs and bytes, then the frames."""
    cuts = range(0, len(keys), FRAME)
    frames = [pack(gaps(keys[s : s + FRAME]), held[s : s + FRAME]) for s in cuts]
    head = np.array([[keys[s], len(keys[s : s + FRAME]), len(f)] for s, f in zip(cuts, frames)], "<u8")
    return np.array([len(frames)], "<u8").tobytes() + head.tobytes() + b"".join(frames)


class Run:
    """The frames of a run, read one after the other."""

    def __init__(self, raw: bytes):
        n = int(np.frombuffer(raw, "<u8", 1)[0])
        self.raw, self.head = raw, np.frombuffer(raw, "<u8", 3 * n, 8).reshape(n, 3)
        self.at, self.next = 8 + 24 * n, 0

    def first(self) -> int | None:
        return int(self.head[self.next][0]) if self.next < len(self.head) else None

    def read(self):
        _, n, size = map(int, self.head[self.next])
        steps, held = unpack(self.raw[self.at : self.at + size], "<u8 <u4", [n, n])
        self.at, self.next = self.at + size, self.next + 1
        return np.cumsum(steps, dtype=np.uint64), held


def merge(runs: list[bytes]):
    """Counts of all pairs of some sorted runs: (run, frame, counts in the frame's order) for each frame, and (A id mixed, highest) for each A id."""
    readers = [Run(x) for x in runs]
    heap = [(r.first(), k) for k, r in enumerate(readers) if r.first() is not None]
    heapq.heapify(heap)
    open_, pending, limit, last = [], 0, PENDING, (-1, 0)
    while heap or open_:
        if heap:
            _, k = heapq.heappop(heap)
            frame, (keys, held) = readers[k].next, readers[k].read()
            open_.append([k, frame, keys, held, []])
            pending += len(keys)
            if (first := readers[k].first()) is not None:
                heapq.heappush(heap, (first, k))
            if heap and pending < limit:
                continue
        bound = heap[0][0] if heap else None  # no frame that is still closed has a smaller pair
        ready = [len(f[2]) if bound is None else int(np.searchsorted(f[2], np.uint64(bound))) for f in open_]
        if sum(ready):
            keys, inverse = np.unique(np.concatenate([f[2][:n] for f, n in zip(open_, ready)]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([f[3][:n] for f, n in zip(open_, ready)])).astype(np.int64)
            ids = (keys >> np.uint64(32)).astype(np.int64)
            starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            for a, most in zip(ids[starts].tolist(), np.maximum.reduceat(counts, starts).tolist()):
                if a == last[0]:
                    last = a, max(most, last[1])
                else:
                    if last[0] >= 0:
                        yield "most", *last
                    last = a, most
            at, left = 0, []
            for f, n in zip(open_, ready):
                f[4].append(counts[inverse[at : at + n]])
                at += n
                f[2], f[3] = f[2][n:], f[3][n:]
                if len(f[2]):
                    left.append(f)
                else:
                    yield "frame", f[0], f[1], np.concatenate(f[4])
            open_ = left
        pending = sum(len(f[2]) for f in open_)
        limit = PENDING + 2 * pending
    if last[0] >= 0:
        yield "most", *last


SPILLED = "chunk long, at int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, records binary, part int, run binary"


def spill(docs: DataFrame, path_a: str, path_b: str, pattern: str, part_bits: int) -> DataFrame:
    """Rows of documents (chunk, at, doc_id and their numbers), of chunks (chunk, records) and of runs (chunk, part, run)."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = rows.sparkSession.createDataFrame([], SPILLED).schema

    def work(batches):
        arrow, aligned = to_arrow_schema(schema), Aligned(Tokenizers(path_a, path_b, pattern))
        names, number = arrow.names, TaskContext.get().partitionId() << 24
        batch_of = lambda made: pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in made], schema=arrow)
        chunk = Chunk()

        def spilled():
            records, runs = chunk.spill(part_bits)
            yield batch_of([(number, None, None, None, None, None, None, None, records)])
            for s in range(0, len(runs), 256):
                yield batch_of([(number, *[None] * 8, part, raw) for part, raw in runs[s : s + 256]])

        def aligned_blocks(text):
            for units in aligned.tok.units(text):
                yield units, aligned.learn(set(units))

        def documents(batches):
            """(doc_id, what its text comes to): short texts learn their units together, long ones block by block."""
            for batch in batches:
                for s in range(0, batch.num_rows, 64):
                    ids, texts = (c.to_pylist() for c in batch.slice(s, 64).columns)
                    short = {k: next(aligned.tok.units(t)) for k, t in enumerate(texts) if t and len(t) <= BLOCK}
                    once = aligned.learn(set().union(*short.values()))
                    known = [aligned.document([(short[k], once)]) if k in short else None for k in range(len(texts))]
                    yield from ((i, aligned.document(aligned_blocks(t)) if t and len(t) > BLOCK else x) for i, t, x in zip(ids, texts, known))

        made = []
        for doc_id, found in documents(batches):
            if found is None:
                made.append((number, None, doc_id, 0, 0, 0, 0, ""))
            else:
                *numbers, keys, counts = found
                made.append((number, chunk.docs, doc_id, *numbers))
                chunk.add(keys, counts)
            if len(made) >= 1000 or chunk.size >= RECORDS:
                yield batch_of(made)
                made = []
            if chunk.size >= RECORDS:
                yield from spilled()
                chunk, number = Chunk(), number + 1
        yield batch_of(made)
        if chunk.docs:
            yield from spilled()

    return rows.mapInArrow(work, schema)


def counted(runs: DataFrame) -> DataFrame:
    """Rows (chunk, part, frame, counts) for each frame, and (part, a, most) for each A id."""
    import pandas as pd

    def merged(pdf):
        chunks, part, out = pdf["chunk"].to_list(), int(pdf["part"].iloc[0]), []
        for kind, x, y, *counts in merge(pdf["run"].to_list()):
            out.append((None, part, None, None, x, y) if kind == "most" else (chunks[x], part, y, pack(counts[0].astype("<i8")), None, None))
        made = pd.DataFrame(out, columns=["chunk", "part", "frame", "counts", "a", "most"])
        return made.astype({"chunk": "Int64", "part": "Int64", "frame": "Int64", "a": "Int64", "most": "Int64"})

    return runs.select("chunk", "part", "run").groupBy("part").applyInPandas(merged, "chunk long, part long, frame long, counts binary, a long, most long")


def contributions(records: DataFrame, counts: DataFrame, most: DataFrame) -> DataFrame:
    """(chunk, at, n_best, count_sum) of each document with tokens."""
    known = np.zeros(1 << ID_BITS, np.int64)  # one number for each A id
    for r in most.toLocalIterator():
        known[r.a] = r.most
    shared = counts.sparkSession.sparkContext.broadcast(known)

    def make():
        def one(raw, frames):
            n_pairs, n, n_docs = np.frombuffer(raw, "<i8", 3).tolist()
            steps, held, docs, times = unpack(raw[24:], "<u8 <u4 <u4 <u4", [n_pairs, n_pairs, n, n])
            total = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(f["counts"]), "<i8") for f in frames] or [np.zeros(0, np.int64)])
            ids = (np.cumsum(steps, dtype=np.uint64) >> np.uint64(32)).astype(np.int64)
            best, of = total == shared.value[ids], np.repeat(np.arange(n_pairs), held)
            sums, bests = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
            np.add.at(sums, docs, total[of] * times)
            np.add.at(bests, docs, best[of] * times.astype(np.int64))
            return [{"at": k, "n_best": b, "count_sum": s} for k, (b, s) in enumerate(zip(bests.tolist(), sums.tolist()))]

        return lambda raws, frames: ([one(x, f or []) for x, f in zip(raws, frames)],)

    back = counts.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("part", "frame", "counts"))).alias("frames"))
    rows = records.join(back, "chunk", "left")
    return map_slices(rows, ["chunk"], ["records", "frames"], "docs array<struct<at int, n_best long, count_sum long>>", make).select("chunk", F.inline("docs"))


def report(docs: DataFrame, path_a: str, path_b: str, pattern: str) -> DataFrame:
    """One row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    tasks = max(1, docs.rdd.getNumPartitions())
    bits = min(12, max(6, math.ceil(math.log2(tasks))))
    spilled = durable(spill(docs, path_a, path_b, pattern, bits), "alignment-spill")
    counts = durable(counted(spilled.filter("run IS NOT NULL")), "alignment-counts")
    gains = contributions(spilled.filter("records IS NOT NULL").select("chunk", "records"), counts.filter("chunk IS NOT NULL").select("chunk", "part", "frame", "counts"), counts.filter("a IS NOT NULL").select("a", "most"))
    rows = spilled.filter("records IS NULL AND run IS NULL").select("chunk", "at", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.join(gains, ["chunk", "at"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
