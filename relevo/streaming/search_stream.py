"""The online search of the source system as a Structured Streaming job.

Queries arrive as files ``(query_id, text)``; each micro-batch is cleaned and
scored against a prebuilt BM25 index (postings written to shared storage) with
the same batch operators, and the top n rows per query are appended to a
parquet sink. ``foreachBatch`` keeps the job stateless (no streaming
aggregation state), and the checkpoint lets a
restarted driver resume at the last committed batch. A batch that is re-run
after a failure overwrites its own ``epoch=`` folder, so output stays exactly-once.
Source, sink and checkpoint are paths of the caller: a restart with the same three
goes on where the last run ended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevo.functions import text as tx
from relevo.operators import bm25
from relevo.session import checkpoint_dir

QUERY_SCHEMA = "item_id BIGINT, text STRING"


def start(spark: SparkSession, index: bm25.Bm25Index, source_dir: str, sink_dir: str, checkpoint: str, n: int = 10,
          glob: str = "*.parquet"):
    """Start the stream, or resume it from ``checkpoint``; returns the ``StreamingQuery``."""
    stream = (spark.readStream.schema(QUERY_SCHEMA).option("pathGlobFilter", glob)
              .option("maxFilesPerTrigger", 100).parquet(source_dir))

    def score_batch(batch: DataFrame, epoch_id: int) -> None:
        q = batch.select(F.col("item_id").alias("query_id"), tx.clean_search("text").alias("text"))
        top = bm25.top_n(index, q, n=n)
        (top.select(F.col("query_id").cast("bigint"), F.col("product_uid").cast("bigint"),
                    F.col("rank").cast("bigint"), F.col("score").cast("double"))
            .write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/epoch={epoch_id}"))

    return stream.writeStream.foreachBatch(score_batch).option("checkpointLocation", checkpoint).start()


def run_once(spark: SparkSession, index: bm25.Bm25Index, source_dir: str, n: int = 10, glob: str = "*.parquet",
             sink_dir: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process every query file not yet processed, stop, and return the sink contents."""
    new = f"{checkpoint_dir(spark).rstrip('/')}/stream-search-{uuid.uuid4().hex[:8]}"
    sink = sink_dir or f"{new}/sink"
    sq = start(spark, index, source_dir, sink, checkpoint or f"{new}/checkpoint", n=n, glob=glob)
    try:
        sq.processAllAvailable()
    finally:
        sq.stop()
    return spark.read.parquet(sink).drop("epoch")
