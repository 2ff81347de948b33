"""Physical plan shape of the flagship query: pruned scans, broadcast query words, top-n limits."""

from relevo.functions import text as tx
from relevo.operators import bm25
from relevo.sources import fixtures as fx
from relevo.sources import tables as T
from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_plan(spark):
    d = T.documents(spark, SF_SMALL, ("doc_id", "text"))
    scan = _plan(d)
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in scan or "struct<doc_id:bigint,text:string>" in scan
    idx = bm25.build_okapi(d.select(d.doc_id.alias("product_uid"), tx.clean_text("text").alias("text")))
    q = fx.queries(spark, SF_SMALL).select("query_id", tx.clean_search("text").alias("text"))
    plan = _plan(bm25.top_n(idx, q, n=10))
    assert "BroadcastHashJoin" in plan          # query words broadcast to the postings scan
    assert "FlatMapGroupsInArrow" in plan       # a block of documents is one group
    assert "WindowGroupLimit" in plan           # top-n trimmed before the final window
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_query_reads_its_buckets_only(spark, tmp_path):
    d = T.documents(spark, SF_SMALL, ("doc_id", "text"))
    path = str(tmp_path / "index")
    built = bm25.build_okapi(d.select(d.doc_id.alias("product_uid"), tx.clean_text("text").alias("text")), path=path)
    idx = bm25.open_okapi(spark, path)  # another session would open it like this
    assert (idx.n_docs, idx.avgdl, idx.buckets) == (built.n_docs, built.avgdl, built.buckets)
    word = idx.postings.first()["term"]
    q = spark.createDataFrame([(1, word)], "query_id long, text string")
    s = bm25.score(idx, q)
    plan = _plan(s)
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    files = {r[0] for r in idx.postings.where(idx.postings["bucket"] == bm25.query_terms(q).select(
        bm25._bucket("term", idx.buckets)).first()[0]).select("_metadata.file_path").distinct().collect()}
    assert 0 < len(files) < len(idx.postings.inputFiles())
    assert s.count() == sum(r.n for r in idx.postings.where(idx.postings["term"] == word).collect())


def test_stream_resumes_after_a_stop(spark, tmp_path):
    from relevo.streaming import search_stream
    docs = spark.createDataFrame([(1, "red drill"), (2, "blue saw")], "product_uid long, text string")
    idx = bm25.build_okapi(docs)
    src, sink, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    put = lambda i, t: spark.createDataFrame([(i, t)], "item_id long, text string").coalesce(1).write.mode("append").parquet(src)
    put(1, "red")
    first = search_stream.run_once(spark, idx, src, sink_dir=sink, checkpoint=ckpt).collect()
    put(2, "saw")
    both = search_stream.run_once(spark, idx, src, sink_dir=sink, checkpoint=ckpt).collect()
    assert [r.query_id for r in first] == [1] and sorted((r.query_id, r.product_uid) for r in both) == [(1, 1), (2, 2)]
    again = search_stream.run_once(spark, idx, src, sink_dir=sink, checkpoint=ckpt).collect()
    assert len(again) == 2
