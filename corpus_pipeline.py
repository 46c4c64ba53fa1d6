"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers

from codeatlas.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from codeatlas.sources.scratch import durable, read_table


def drop_toxic(spark, docs, sf_dir):
    """Documents with a toxicity score of 0.7 or more go."""
    return toxicity.reject(docs, read_table(spark, sf_dir, "labels"))


def drop_copies(spark, docs, sf_dir):
    """Of equal texts the one with the largest id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark, docs, sf_dir):
    """Of each class of near copies the document with the smallest id stays."""
    return ngram_join.keep_first(docs)


def mix(spark, docs, sf_dir):
    """The documents that the budgets of the source tree take."""
    return mixing.keep_selected(docs)


def encode(spark, docs, sf_dir):
    """Token counts and digests of what is left."""
    return bpe.report(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", encode),
]

#: The toxicity, near-copy and BPE stages are not SQL; the pipeline is tested against a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
