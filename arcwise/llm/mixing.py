"""Mixing sources to target weights by entropy balancing.

Every document gets a rate exp(lambda_s * z), z its size over its source's
mean size, held at the cap. The multipliers solve the convex dual of staying
close to rate one while each source's expected words meet its target; Newton
steps run on the cluster over counts by (source, size), safeguarded by a
bracket. The rates are then rounded to whole copies: largest sizes first, the
remainder carried in words, so a source misses its target by about its
smallest documents. Copies are dealt to equal-sized documents by bucketed
ranks, so no task ever holds a whole source.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LONG, STR, keep, schema

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2.0
#: Documents of one rank bucket, in the mean.
BUCKET_ROWS = 50_000
STEPS, TOLERANCE = 40, 1e-9


def capped_targets(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Share total by weight, no target above cap times its size.

    The excess of full sources goes to the others by weight until none is
    above; if all are full the rest is dropped. Sources without words get 0.
    """
    targets, free, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], total
    while free:
        weight = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / weight > cap * sizes[i]]
        if not full:
            for i in free:
                targets[i] = left * weights[i] / weight
            break
        for i in full:
            targets[i] = cap * sizes[i]
            left -= targets[i]
        free = [i for i in free if i not in set(full)]
        left = max(left, 0.0)
    return targets


def source_targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """capped_targets over sources(source, n, source_size), on the cluster.

    Capping order is by cap * size / weight: sorted by it, the capped sources
    are a prefix, found by running sums. One row for each source goes through
    the window, never a document.
    """
    first = Window.orderBy(F.col("source").asc_nulls_last())
    picks = F.array(*map(F.lit, weights))
    ranked = sources.withColumn("weight", picks[(F.row_number().over(first) - 1) % len(weights)]).withColumn("ratio", F.col("source_size") * cap / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    sums = (
        ranked.withColumn("full_before", F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("all_weight", F.sum("weight").over(every))
        .withColumn("total", F.sum("source_size").over(every) * share)
    )
    # level: words for one unit of weight if exactly the sources before this one were full
    level = (F.col("total") - F.col("full_before")) / (F.col("all_weight") - F.col("weight_before"))
    open_ = sums.withColumn("level", level).withColumn("mine", F.when(F.col("ratio") >= F.col("level"), F.col("level")))
    final = F.max("mine").over(every)  # the first source that is not full sets the level; later ones give less
    target = F.when(final.isNull(), F.col("source_size") * cap).otherwise(F.least(F.col("source_size") * cap, F.greatest(final, F.lit(0.0)) * F.col("weight")))
    return open_.select("source", "n", "source_size", target.cast("double").alias("target"))


def solve_rates(cells: DataFrame, sources: DataFrame, cap: float) -> DataFrame:
    """Multipliers lambda by source: rows (source, lam).

    cells: (source, size, n). Each Newton step is one aggregation over the
    cells; sources whose target is all they may give keep lam = infinity.
    """
    state = keep(
        sources.select(
            "source",
            "target",
            (F.col("source_size") / F.greatest("n", F.lit(1))).alias("mean"),
            (F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)).alias("full"),
            F.lit(0.0).alias("lam"),
            F.lit(-1e300).alias("low"),
            F.lit(1e300).alias("high"),
            F.lit(False).alias("done"),
        ).withColumn("done", F.col("full") | (F.col("target") <= 0)),
        "mix-state",
    )
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    for _ in range(STEPS):
        if state.where("not done").isEmpty():
            break
        z = F.col("size") / F.col("mean")
        joined = cells.join(state.where("not done"), same(cells, state)).drop(cells["source"])
        rate = F.least(F.lit(cap), F.exp(F.least(F.col("lam") * z, F.lit(50.0))))
        words = F.col("n") * F.col("size")
        sums = joined.groupBy("source").agg(F.sum(words * rate).alias("got"), F.sum(F.when(rate < cap, words * rate * z).otherwise(0.0)).alias("slope"))
        s = state.join(sums.withColumnRenamed("source", "_s"), state["source"].eqNullSafe(F.col("_s")), "left").drop("_s")
        gap = F.col("got") - F.col("target")
        low = F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(gap >= 0, F.col("lam")).otherwise(F.col("high"))
        s = s.withColumns({"low": F.when(F.col("done"), F.col("low")).otherwise(low), "high": F.when(F.col("done"), F.col("high")).otherwise(high)})
        newton = F.col("lam") - gap / F.greatest("slope", F.lit(1e-12))
        middle = (F.greatest("low", F.col("lam") - 64.0) + F.least("high", F.col("lam") + 64.0)) / 2
        step = F.when((newton > F.col("low")) & (newton < F.col("high")) & (F.abs(newton - F.col("lam")) < 64.0), newton).otherwise(middle)
        near = F.abs(gap) <= TOLERANCE * F.col("target")
        s = s.withColumns({"lam": F.when(F.col("done") | near, F.col("lam")).otherwise(step), "done": F.col("done") | near})
        state = keep(s.select(state.columns), "mix-state")
    return state


def _round_source(cells: pd.DataFrame) -> pd.DataFrame:
    """Copies of each (size) cell of one source, largest first, remainder carried in words."""
    cells = cells.sort_values("size", ascending=False)
    carry, copies = 0.0, []
    for size, n, want, most in zip(cells["size"], cells["n"], cells["want"], cells["most"], strict=True):
        if size == 0:
            copies.append(int(n))
            continue
        goal = want * size + carry
        k = min(max(int(goal / size + 0.5), 0), int(most))
        carry = goal - k * size
        copies.append(k)
    return cells.assign(copies=copies)[["source", "size", "n", "copies"]].astype({"copies": "int64"})


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, bucket_rows: int = BUCKET_ROWS, texts: bool = True
) -> DataFrame:
    """docs with size, source_size, target, rate, copies, taken added.

    Needs docs(doc_id, text, source); other columns pass through unless they
    bear the names of the added ones, which are replaced. Null text has size
    0; a null source is a source, ordered last. Documents of size 0 have one
    copy and take nothing. Repeated rows count as separate documents. An
    empty table gives an empty result. Whole copies only, at most cap of a
    document; reruns agree. texts=False returns doc_id and source alone with
    the added columns, so that no text is shuffled.
    """
    added = ("size", "source_size", "target", "rate", "copies", "taken")
    docs = docs.drop(*added)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.xxhash64("doc_id", "text")
    slim = keep(docs.select("doc_id", key.alias("_key"), "source", size.alias("size")), "mix-sizes")
    total = slim.count()
    buckets = max(1, -(-total // bucket_rows))
    fine = keep(slim.groupBy("source", "size", F.pmod("_key", F.lit(buckets)).alias("_bucket")).agg(F.count(F.lit(1)).alias("m")), "mix-fine")
    cells = keep(fine.groupBy("source", "size").agg(F.sum("m").alias("n")), "mix-cells")
    sources = keep(source_targets(cells.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, share, cap), "mix-sources")
    state = solve_rates(cells, sources, cap)

    s = state.select(F.col("source").alias("_s"), "mean", "full", "lam", F.col("target").alias("_t"))
    rate = F.when(F.col("full"), F.lit(cap)).when(F.col("_t") <= 0, F.lit(0.0)).otherwise(F.least(F.lit(cap), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0)))))
    rated = cells.join(s, cells["source"].eqNullSafe(F.col("_s"))).select("source", "size", "n", F.when(F.col("size") == 0, F.lit(1.0)).otherwise(rate).alias("rate"))
    rated = rated.withColumns({"want": F.col("n") * F.col("rate"), "most": F.floor(F.lit(cap)) * F.col("n")})
    rounded = keep(rated.groupBy("source").applyInPandas(_round_source, schema(source=STR, size=LONG, n=LONG, copies=LONG)), "mix-copies")

    # Copies of a cell are dealt to its buckets in proportion, by running floors.
    run = Window.partitionBy("source", "size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    r = rounded.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "n", "copies")
    dealt = fine.join(r, fine["source"].eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))).withColumn("_run", F.sum("m").over(run))
    share_of = lambda c: F.floor(c.cast("decimal(38,0)") * F.col("copies") / F.col("n")).cast("long")
    dealt = dealt.select("_s", "_z", F.col("_bucket").alias("_b"), "m", (share_of(F.col("_run")) - share_of(F.col("_run") - F.col("m"))).alias("_k"))
    src = sources.select(F.col("source").alias("_s2"), "source_size", "target")
    rt = rated.select(F.col("source").alias("_s3"), F.col("size").alias("_z3"), "rate")
    dealt = dealt.join(src, F.col("_s").eqNullSafe(F.col("_s2"))).join(rt, F.col("_s").eqNullSafe(F.col("_s3")) & (F.col("_z") == F.col("_z3"))).drop("_s2", "_s3", "_z3")

    rank = Window.partitionBy("source", "size", "_bucket").orderBy("_key", "doc_id")
    rows = (docs.withColumns({"size": size, "_key": key}) if texts else slim).withColumn("_bucket", F.pmod("_key", F.lit(buckets)))
    rows = rows.withColumn("_rank", F.row_number().over(rank))
    out = rows.join(dealt, rows["source"].eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("_bucket") == F.col("_b")))
    copies = (F.floor(F.col("_k") / F.col("m")) + F.when(F.col("_rank") <= F.col("_k") % F.col("m"), 1).otherwise(0)).cast("long")
    return out.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop("_key", "_bucket", "_rank", "_s", "_z", "_b", "_k", "m")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents."""
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")
