from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SMALL


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    seen = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), docs.schema)
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[2] < seen[1] < seen[0] and seen[-1] > 0.7 * seen[0]
    want = {(r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()}
    assert {(r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SMALL).collect()} == want


def test_run_equals_a_plain_version(spark):
    """Scores come from the operator (held-out accuracy is tested apart); all other stages are done by hand."""
    from codeatlas.llm import mixing, toxicity
    from tests.llm import test_bpe, test_mixing, test_ngram_join

    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    fine = {r.doc_id for r in toxicity.report(docs, labels).filter("predicted = 0").collect()}
    rows = [r for r in docs.collect() if r.doc_id in fine]
    last = {r.text or "": r.doc_id for r in sorted(rows, key=lambda r: r.doc_id)}
    rows = [r for r in rows if last[r.text or ""] == r.doc_id]
    first = {i for i, c, _, _ in test_ngram_join.brute([(r.doc_id, r.text) for r in rows]) if i == c}
    rows = [r for r in rows if r.doc_id in first]
    words = {r.doc_id: len(test_ngram_join.nj.WORDS.findall(r.text or "")) for r in rows}
    leaves = [(r.doc_id, f"d{int(r.source[3:]) % 4}", r.lang, r.source, words[r.doc_id]) for r in rows]
    copies = test_mixing.plain(leaves, {}, int(sum(words.values()) * 0.9), 1, 7)
    enc = test_bpe.plain()
    want = {(r.doc_id, len(enc.encode_ordinary(r.text or ""))) for r in rows if copies[r.doc_id]}
    assert mixing.BUDGET_SHARE == 0.5 and {(r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, SMALL).collect()} == want


CLASHING = dict(keep_id=7, kept="k", group_size=1, score=0.5, toxicity=0.1, _id=3, _hash=4, set_key="s", rep=5, row=6, slots="x", copies=2, domain="d", _toxicity=0.2, class_id=8, label="l")


def test_every_stage_gives_back_the_callers_rows(spark, odd_docs, no_docs):
    """Nulls, empty and very long texts, copies, and columns with names that the operators use."""
    named = lambda df: df.select("doc_id", "text", "lang", "source", "n_chars").withColumns({k: F.lit(v) for k, v in CLASHING.items()})
    docs, empty = named(odd_docs), named(no_docs)
    given = Counter(map(str, docs.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SMALL)
        assert got.columns == docs.columns, name
        assert not Counter(map(str, got.collect())) - given, name
        assert stage(spark, empty, SMALL).collect() == []
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, SMALL).count() == docs.count() and last(spark, empty, SMALL).count() == 0


def test_run_over_odd_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    labels = spark.createDataFrame([(6, 1, 0), (4, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", odd_docs), ("empty", no_docs)):
        docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.limit(3 if name == "odd" else 0).write.parquet(str(tmp_path / name / "labels.parquet"))
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()}
    assert got <= {2, 4, 3, 5, 6, 7, 8, 9, None} and len(got) > 2
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
