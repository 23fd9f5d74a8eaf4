"""A stored index against one that is built anew, and what it reads and writes."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracewell.operators import retrieval as R
from tracewell.operators import stored_index as I

DOCS = "doc_id long, mtime long, doc_type string, content string"


def corpus(spark, n=300, bump=(), words=""):
    rows = [(k, 2 if k in bump else 1, "md" if k % 3 else "py", " ".join(f"word{(k * j) % 97:03d} common{words if k in bump else ''}" for j in range(1, 20))) for k in range(n)]
    return spark.createDataFrame(rows, DOCS)


def queries(spark, *terms):
    return spark.createDataFrame([(1, t) for t in terms], "q long, term string")


def found(df):
    return sorted(map(tuple, df.select("q", "doc", "score", "rank").collect()))


def plain(spark, docs, terms, k=10):
    post = R.postings(docs)
    return found(R.bm25(post, queries(spark, *terms), k)), found(R.tfidf(post, queries(spark, *terms), k))


def files(path):
    return {str(p): p.stat().st_size for p in Path(path.removeprefix("file://")).rglob("*.parquet")}


def test_updates_equal_a_rebuild(spark, tmp_path):
    path, terms = f"file://{tmp_path}/index", ("word003", "word017", "fresh", "common", "absent")
    first = corpus(spark)
    I.update(spark, path, first)
    assert (found(I.bm25(spark, path, queries(spark, *terms), 10)), found(I.tfidf(spark, path, queries(spark, *terms), 10))) == plain(spark, first, terms)
    before = files(path)
    # three documents are changed, one is new, two are removed; an older version of one is no change
    second = corpus(spark, 301, {5, 100, 250}, " fresh").where("doc_id NOT IN (7, 8)")
    stale = spark.createDataFrame([(9, 0, "md", "older words")], DOCS)
    now = I.update(spark, path, second.where("doc_id <> 9").unionByName(stale), removed=spark.createDataFrame([(7,), (8,), (999,)], "doc long"))
    assert now.docs == 299 and [s.docs for s in now.segments] == [300, 4] and now.segments[1].gone == 5
    after = files(path)
    assert {f: n for f, n in after.items() if f in before} == before
    assert sum(n for f, n in after.items() if f not in before) < 0.3 * sum(before.values())
    want = plain(spark, second, terms)
    assert (found(I.bm25(spark, path, queries(spark, *terms), 10)), found(I.tfidf(spark, path, queries(spark, *terms), 10))) == want
    # nothing new: nothing is written
    assert I.update(spark, path, second).version == now.version
    # a removed document comes back
    I.update(spark, path, corpus(spark).where("doc_id = 7"))
    merged = I.merge(spark, path, 1 << 40)
    assert len(merged.segments) == 1 and merged.segments[0].gone == 0 and merged.docs == 300
    third = second.unionByName(corpus(spark).where("doc_id = 7"))
    assert (found(I.bm25(spark, path, queries(spark, *terms), 10)), found(I.tfidf(spark, path, queries(spark, *terms), 10))) == plain(spark, third, terms)
    assert I.vacuum(spark, path) >= 3 and len(list((tmp_path / "index/manifests").glob("*.json"))) == 1
    assert found(I.bm25(spark, path, queries(spark, *terms), 10)) == plain(spark, third, terms)[0]
    assert {r.doc_type: r.n for r in I.status(spark, path).collect()} == {r["doc_type"]: r["count"] for r in third.groupBy("doc_type").count().collect()}


def test_merge_of_small_segments(spark, tmp_path):
    """Only small segments are rewritten; tombstones of what stays outlive the merge."""
    path = f"file://{tmp_path}/index"
    I.update(spark, path, corpus(spark))
    for k in (3, 4, 3):
        now = I.update(spark, path, corpus(spark, bump={k}, words=" fresh").where(f"doc_id = {k}").withColumn("mtime", F.lit(10 + len(I.manifest(spark, path).segments))))
    assert len(now.segments) == 4
    merged = I.merge(spark, path, 1000)
    assert [s.docs for s in merged.segments] == [300, 2] and merged.segments[1].gone == 2 and merged.segments[0] == now.segments[0]
    assert I.live_docs(spark, path).count() == merged.docs == 300
    assert found(I.bm25(spark, path, queries(spark, "fresh"), 5)) == plain(spark, corpus(spark, bump={3, 4}, words=" fresh"), ("fresh",), 5)[0]


def scanned(df):
    """Rows that the scans of an executed plan gave, by the metrics of the plan that ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        else:
            if name.startswith("Scan parquet"):
                total += node.metrics().apply("numOutputRows").value()
            todo += [node.children().apply(k) for k in range(node.children().size())]
    return total


def test_a_search_reads_its_terms_pages(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit(1).alias("mtime"), F.lit("md").alias("doc_type"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(20)), lambda j: F.concat(F.lit("term"), F.lpad((F.pmod(F.xxhash64("id", j), F.lit(9000))).cast("string"), 5, "0")))).alias("content"))
    now = I.update(spark, path, docs)
    rows = now.segments[0].postings
    assert rows > 100_000
    got = I.lists(spark, path, queries(spark, "term04321", "term00017"))
    assert 0 < got.count() < 100 and scanned(got) < 0.1 * rows
    many = spark.range(400).select(F.lit(1).alias("q"), F.concat(F.lit("term"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("term"))
    assert I.lists(spark, path, many).count() == R.postings(docs).join(many, "term", "left_semi").count()


def test_one_writer_of_a_version(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    now = I.update(spark, path, corpus(spark, 5))
    with pytest.raises(Exception, match="already exists"):
        I._commit(spark, path, now)
    assert I.manifest(spark, path) == now


def test_odd_rows(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    rows = [(None, 1, "md", "lost words"), (1, None, None, None), (2, 1, "md", ""), (3, 1, "md", "twice here"), (3, 2, "md", "twice there"), (3, 2, "md", "twice there"), (4, 1, "md", "long " * 100_000)]
    now = I.update(spark, path, spark.createDataFrame(rows, DOCS).withColumn("gen", F.lit("x")).withColumn("dl", F.lit("y")))
    assert now.docs == 4 and {(r.term, r.doc, r.tf, r.dl) for r in I.lists(spark, path, queries(spark, "twice", "there", "here", "long", "lost")).collect()} == {("twice", 3, 1, 2), ("there", 3, 1, 2), ("long", 4, 100_000, 100_000)}
    empty = f"file://{tmp_path}/empty"
    assert I.update(spark, empty, spark.createDataFrame([], DOCS)).docs == 0
    assert I.bm25(spark, empty, queries(spark, "a"), 3).count() == 0 and I.bm25(spark, f"{empty}2", queries(spark, "a"), 3).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_posting_is_shuffled_once(spark, tmp_path, monkeypatch):
    """Terms are counted within their document's row; only the ranges of a segment are a shuffle."""
    path, seen, write = f"file://{tmp_path}/index", [], I._write

    def spy(spark, path, gen, docs, postings, gone):
        seen.append((plan_of(postings), sorted(map(tuple, postings.select("term", "doc", "tf", "dl").collect()))))
        return write(spark, path, gen, docs, postings, gone)

    monkeypatch.setattr(I, "_write", spy)
    texts = {1: "bbb aaa bbb", 2: None, 3: "", 4: "aaa", 5: "zzz yyy zzz zzz aaa yyy", 6: "1a 22 no"}
    I.update(spark, path, spark.createDataFrame([(k, 1, "md", x) for k, x in texts.items()], DOCS))
    plan, rows = seen[0]
    assert "Exchange" not in plan and "Aggregate" not in plan
    assert rows == [("aaa", 1, 1, 3), ("aaa", 4, 1, 1), ("aaa", 5, 1, 6), ("bbb", 1, 2, 3), ("yyy", 5, 2, 6), ("zzz", 5, 3, 6)]


def test_weights_of_fields_are_counted(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    I.update(spark, path, spark.createDataFrame([(1, 1, "md", "# about apples\napples", "src/apples.py"), (2, 1, "md", None, None)], DOCS + ", path string"), file_path="path")
    got = {r.term: (r.tf, r.dl) for r in I.lists(spark, path, queries(spark, "apples", "about", "src")).collect()}
    assert got == {"apples": (5 + 3 + 2, 24), "about": (3 + 1, 24), "src": (5, 24)}


def test_generations_are_a_partition_column(spark, tmp_path):
    """No row's generation is cut from the name of its file."""
    path = f"file://{tmp_path}/index"
    I.update(spark, path, corpus(spark, 20))
    I.update(spark, path, corpus(spark, 21, {3}, " fresh"))
    live = I.live_docs(spark, path)
    assert "file_path" not in plan_of(live) and "regexp" not in plan_of(live).lower()
    assert {r.doc: r.gen for r in live.collect()} == {k: 2 if k in (3, 20) else 1 for k in range(21)}
