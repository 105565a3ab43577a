"""Streaming edges: additive aggregates in update mode, and a sketch that grows by batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.linalg import co_sketch, sketch


def stream_degrees(edges: DataFrame) -> DataFrame:
    """(id, out_deg, in_deg, w_out, w_in) of streamed edges; repeats count each time. For update or complete mode."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("w").alias("wo"), F.lit(0.0).alias("wi")).unionAll(edges.select("dst", F.lit(0), F.lit(1), F.lit(0.0), "w"))
    return ends.groupBy("id").agg(F.sum("o").alias("out_deg"), F.sum("i").alias("in_deg"), F.sum("wo").alias("w_out"), F.sum("wi").alias("w_in"))


def stream_windowed_counts(events: DataFrame, key: str, time: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, key, n) by event time; rows later than the watermark are left out. For append mode."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))


class StreamingSketch:
    """G and H of reachability that arrives by batches of whole sources: G is appended, H is added up."""

    def __init__(self, folder: str, width: int, seed: int = 1):
        self.folder, self.width, self.seed = folder.rstrip("/"), width, seed

    def update(self, batch: DataFrame, epoch: int) -> None:
        """One batch of (source, node, r); running it again for an epoch replaces what it wrote."""
        batch = batch.select("source", "node", "r")
        g = sketch(batch, self.width, self.seed)
        g.write.mode("overwrite").parquet(f"{self.folder}/g/epoch={epoch}")
        kept = batch.sparkSession.read.parquet(f"{self.folder}/g/epoch={epoch}")
        co_sketch(batch, kept).write.mode("overwrite").parquet(f"{self.folder}/h/epoch={epoch}")

    def start(self, reach: DataFrame, checkpoint: str) -> StreamingQuery:
        return reach.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def result(self, spark) -> tuple[DataFrame, DataFrame]:
        """(source, g) and (node, h) over all batches so far."""
        h = spark.read.parquet(f"{self.folder}/h").select("node", F.posexplode("h").alias("j", "x")).groupBy("node", "j").agg(F.sum("x").alias("x"))
        h = h.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("j", "x"))).alias("h")).select("node", F.col("h.x").alias("h"))
        return spark.read.parquet(f"{self.folder}/g").select("source", "g"), h
