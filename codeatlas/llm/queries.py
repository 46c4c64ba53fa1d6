"""Queries of this package and their SQL."""

from __future__ import annotations

import public_tokenizers

from codeatlas.llm import alignment, bpe, chat, exact_dedup, html_extract, lexical, mixing, near_dedup, ngram_join, pii, quality, secrets, toxicity
from codeatlas.sources.scratch import read_table


def op2_byte_bpe(spark, sf_dir):
    return bpe.report(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.report(read_table(spark, sf_dir, "documents"))


def op7_pii(spark, sf_dir):
    return pii.report(read_table(spark, sf_dir, "documents"))


def op1_ngram_join(spark, sf_dir):
    return ngram_join.join(read_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark, sf_dir):
    return quality.report(read_table(spark, sf_dir, "documents"))


def op5_chat_quotes(spark, sf_dir):
    return chat.report(read_table(spark, sf_dir, "conversations"))


def op6_secret_scan(spark, sf_dir):
    return secrets.report(read_table(spark, sf_dir, "documents"))


def op8_html_text(spark, sf_dir):
    return html_extract.report(read_table(spark, sf_dir, "pages"))


def op9_toxicity(spark, sf_dir):
    return toxicity.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_mixing(spark, sf_dir):
    return mixing.report(read_table(spark, sf_dir, "documents"))



def op11_tokenizer_alignment(spark, sf_dir):
    return alignment.report(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


def op12_tensored_near_dedup(spark, sf_dir):
    return near_dedup.report(read_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark, sf_dir):
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_join, op2_byte_bpe, op3_exact_dedup, op4_quality_rules, op5_chat_quotes, op6_secret_scan, op7_pii, op8_html_text, op9_toxicity, op10_mixing,
        op11_tokenizer_alignment, op12_tensored_near_dedup, op13_lexical_search,
    )
}
ORACLE = {"op1_ngram_join": ngram_join.SQL, "op3_exact_dedup": exact_dedup.SQL, "op4_quality_rules": quality.SQL, "op5_chat_quotes": chat.SQL, "op7_pii": pii.SQL, "op10_mixing": mixing.SQL, "op12_tensored_near_dedup": near_dedup.SQL, "op13_lexical_search": lexical.SQL}
