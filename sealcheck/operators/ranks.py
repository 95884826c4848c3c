"""Exact order statistics without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from sealcheck.session import materialise

SPLITS = 512
PREFIX_HEX = 4          # 65,536 digest buckets


def exact_percentiles(values: DataFrame, group: str, value: str, probabilities: list[float]) -> DataFrame:
    """(group, probability, percentile) with linear interpolation between ranks.

    Equal values are counted first. Approximate quantiles of the distinct values cut each
    group into ranges, counts per range locate the wanted ranks, and only the ranges that
    hold one are ordered. The group column must have few values (here: features).
    """
    counts = materialise(values.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n")))
    steps = [i / SPLITS for i in range(1, SPLITS)]
    cuts = counts.groupBy(group).agg(F.percentile_approx(value, steps, 10_000).alias("cuts"))
    ranged = counts.join(F.broadcast(cuts), group).withColumn(       # one row per group
        "range", F.size(F.filter("cuts", lambda c: c < F.col(value)))).drop("cuts")
    so_far = W.partitionBy(group).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranged.groupBy(group, "range").agg(F.sum("n").alias("size")) \
        .withColumn("below", F.coalesce(F.sum("size").over(so_far), F.lit(0)))     # <= SPLITS rows per group
    totals = ranges.groupBy(group).agg(F.sum("size").alias("total"))
    wanted = totals.select(group, F.explode(F.array(*map(F.lit, probabilities))).alias("probability"), "total") \
        .withColumn("position", F.col("probability") * (F.col("total") - 1)) \
        .withColumn("low", F.floor("position")).withColumn("high", F.ceil("position"))
    inside = ((F.col("low") < F.col("below") + F.col("size")) & (F.col("high") >= F.col("below")))
    needed = ranges.join(F.broadcast(wanted), group).filter(inside).select(group, "range", "below").distinct()
    order = W.partitionBy(group, "range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    placed = (ranged.join(F.broadcast(needed), [group, "range"])
              .withColumn("start", F.col("below") + F.coalesce(F.sum("n").over(order), F.lit(0)))
              .withColumn("end", F.col("start") + F.col("n") - 1))
    hits = placed.join(F.broadcast(wanted), group).filter((F.col("low") <= F.col("end")) & (F.col("high") >= F.col("start")))
    at_low = F.max(F.when(F.col("low").between(F.col("start"), F.col("end")), F.col(value)))
    at_high = F.max(F.when(F.col("high").between(F.col("start"), F.col("end")), F.col(value)))
    return (hits.groupBy(group, "probability").agg(
                at_low.alias("a"), at_high.alias("b"), F.max("position").alias("position"))
            .select(group, "probability",
                    (F.col("a") + (F.col("b") - F.col("a")) * (F.col("position") - F.floor("position"))).alias("percentile")))


def lowest_share(rows: DataFrame, group: str, digest: str, share: float) -> DataFrame:
    """Add ``chosen``: the ceil(share * n) rows of each group with the lowest hex digest.

    Counts per digest prefix find the prefix where the cut falls; only rows with that prefix
    are ranked to find the exact digest of the cut. The rows are read three times, so they are
    written once.
    """
    rows = materialise(rows)
    prefix = F.substring(digest, 1, PREFIX_HEX)
    sized = rows.groupBy(group, prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("size"))
    so_far = W.partitionBy(group).orderBy("prefix").rowsBetween(W.unboundedPreceding, -1)
    totals = sized.groupBy(group).agg(F.ceil(F.sum("size") * share).alias("quota"))
    cut = (sized.withColumn("below", F.coalesce(F.sum("size").over(so_far), F.lit(0)))
           .join(F.broadcast(totals), group)
           .filter((F.col("below") < F.col("quota")) & (F.col("quota") <= F.col("below") + F.col("size")))
           .select(group, "prefix", (F.col("quota") - F.col("below")).alias("left")))
    order = F.row_number().over(W.partitionBy(group).orderBy(digest))
    limit = (rows.withColumn("prefix", prefix).join(F.broadcast(cut), [group, "prefix"])   # one prefix per group
             .withColumn("place", order).filter(F.col("place") == F.col("left"))
             .select(group, F.col(digest).alias("last_digest")))
    return (rows.join(F.broadcast(limit), group, "left")
            .withColumn("chosen", F.coalesce(F.col(digest) <= F.col("last_digest"), F.lit(False))).drop("last_digest"))


def place_in_group(rows: DataFrame, keys: list[str], order: list, coarse, name: str) -> DataFrame:
    """Exact row_number per group without ordering a whole group in one task.

    ``coarse`` is a column (a number, or a struct without NULL) that never decreases along ``order``; runs of equal
    ``coarse`` are ranked on their own and shifted by the sizes of earlier runs. Keys may be NULL.
    """
    rows = rows.withColumn("coarse", coarse)
    run_keys = [*keys, "coarse"]
    sizes = rows.groupBy(run_keys).agg(F.count(F.lit(1)).alias("size"))
    before = W.partitionBy(keys).orderBy("coarse").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(k).alias(f"o_{k}") for k in run_keys], F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    same = F.lit(True)
    for key in run_keys:
        same = same & F.col(key).eqNullSafe(F.col(f"o_{key}"))
    inside = F.row_number().over(W.partitionBy(run_keys).orderBy(*order))
    return (rows.join(offsets, same).withColumn(name, F.col("offset") + inside)
            .drop("coarse", "offset", *[f"o_{k}" for k in run_keys]))
