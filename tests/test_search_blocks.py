"""Searches scored in blocks: small blocks, ties, texts without terms, an index of several segments."""

import pytest
from test_stored_index import DOCS, corpus, found, queries

from tracewell.operators import retrieval as R
from tracewell.operators import stored_index as I


def test_small_blocks_give_the_same_and_no_pairs(spark, monkeypatch):
    """Pairs of query and document are not rows of a join, and blocks do not show in results; equal scores go by document."""
    docs = corpus(spark, 200)
    asked = spark.createDataFrame([(q, f"word{(q * j) % 97:03d}") for q in range(8) for j in range(1, 6)] + [(q, "common") for q in range(8)], "q long, term string")
    post = R.postings(docs)
    want = [found(R.bm25(post, asked, 7)), found(R.tfidf(post, asked, 7))]
    assert all(len(w) == 56 for w in want)
    monkeypatch.setattr(R, "BLOCK_HITS", 100)
    monkeypatch.setattr(R, "BLOCK_TERMS", 10)
    assert [found(R.bm25(post, asked, 7)), found(R.tfidf(post, asked, 7))] == want
    plan = R.bm25(post, asked, 7)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan
    tied = found(R.bm25(post, queries(spark, "common"), 5))
    assert [t[1] for t in sorted(tied, key=lambda t: t[3])] == sorted(t[1] for t in tied)


def test_texts_without_terms_do_not_count(spark, tmp_path):
    docs = corpus(spark, 40).unionByName(spark.createDataFrame([(k, 1, "md", None if k % 2 else "1 2") for k in range(1000, 1010)], DOCS))
    path, asked = f"file://{tmp_path}/index", queries(spark, "word003", "common")
    I.update(spark, path, docs)
    post = R.postings(docs)
    assert found(I.bm25(spark, path, asked, 9)) == found(R.bm25(post, asked, 9))
    assert found(I.tfidf(spark, path, asked, 9)) == found(R.tfidf(post, asked, 9))


@pytest.mark.parametrize("search", ["bm25", "tfidf"])
def test_several_segments_without_broadcasts(spark, tmp_path, search):
    """Segments are one scan: a union of them took partitions of unequal numbers to a join."""
    path, asked = f"file://{tmp_path}/index", queries(spark, "word003", "common", "fresh")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        I.update(spark, path, corpus(spark, 60))
        I.update(spark, path, corpus(spark, 70, {3, 5}, " fresh"))
        plan = I.live_docs(spark, path)._jdf.queryExecution().optimizedPlan().toString()
        assert "Union" not in plan
        assert found(getattr(I, search)(spark, path, asked, 9)) == found(getattr(R, search)(R.postings(corpus(spark, 70, {3, 5}, " fresh")), asked, 9))
    finally:
        for k in conf:
            spark.conf.unset(k)
