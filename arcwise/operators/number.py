"""Dense numbers for the rows of a table, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut

#: Bits of a monotonic id that count rows inside a partition.
INSIDE = (1 << 33) - 1


def numbered(rows: DataFrame, order: list, name: str = "number") -> DataFrame:
    """rows with a bigint column name, 0..n-1 in the order of the given columns, which should leave no ties.

    Rows are dealt by ranges of the order and sorted there; only the number
    of rows of each partition reaches the driver.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = cut(sorted_.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect()
    before, total = {}, 0
    for r in sorted(sizes, key=lambda r: r["_part"]):
        before[r["_part"]] = total
        total += r["n"]
    starts = spark.createDataFrame(list(before.items()) or [(0, 0)], "_part long, _before long")  # one row for each partition
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit(INSIDE))).drop("_part", "_before", "_at")
