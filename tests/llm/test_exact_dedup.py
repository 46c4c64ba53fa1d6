from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from codeatlas.llm import exact_dedup


def test_report_matches_plain_grouping(odd_docs):
    groups = defaultdict(list)
    for r in odd_docs.collect():
        groups[r.text or ""].append(r.doc_id)
    got = exact_dedup.report(odd_docs).collect()
    assert len(got) == odd_docs.count()
    texts = {sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = texts[r.text_sha256]
        best = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (best, len(ids), r.doc_id == best)


WEAK = [lambda t: F.substring(F.md5(t), 1, 1), lambda t: F.when(F.length(t) < 3, "short").otherwise(F.md5(t))]


@pytest.mark.parametrize("weak", WEAK)
def test_colliding_hashes_are_told_apart(odd_docs, weak):
    rows = lambda df: sorted((str(r.doc_id), str(r.keep_id_), r.group_size, r.kept_) for r in df.collect())
    assert rows(exact_dedup.with_groups(odd_docs, hash_key=weak)) == rows(exact_dedup.with_groups(odd_docs))
    kept = lambda df: sorted(map(str, df.collect()))
    assert kept(exact_dedup.drop_copies(odd_docs, hash_key=weak)) == kept(exact_dedup.drop_copies(odd_docs))


def test_columns_of_the_caller_come_back(spark, odd_docs, no_docs):
    kept = exact_dedup.drop_copies(odd_docs)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == {4, 5, 6, 7, 8, 9, None}
    given = odd_docs.collect()
    assert all(r in given for r in kept.collect())
    named = spark.createDataFrame([(2, "a", "mine", 6, 1, b"h", "b"), (1, "a", "yours", 7, 2, b"i", "c")], "doc_id long, text string, kept string, keep_id int, hash int, _hash binary, body string")
    assert exact_dedup.drop_copies(named).collect() == [named.first()]
    got = exact_dedup.with_groups(named).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, "a", "yours", 7, 2, b"i", "c", 2, 2, False), (2, "a", "mine", 6, 1, b"h", "b", 2, 2, True)]
    assert exact_dedup.drop_copies(odd_docs, keep="smallest").filter("doc_id = 1").count() == 1
    assert exact_dedup.report(no_docs).count() == 0 and exact_dedup.drop_copies(no_docs).count() == 0
