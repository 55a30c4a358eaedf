"""Exact quantiles and distribution distances of groups of any size.

Spark's ``percentile`` keeps every distinct value of a group in one task's memory.
It is used here only where the calendar or the draw count bounds the group; these
operators cover the rest.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from .ordered import cumulative


def exact_quantiles(df: DataFrame, keys, value: str, probs: dict) -> DataFrame:
    """keys + one column per entry of probs (name -> probability), linear interpolation.

    Equal values are merged first (a hot group spreads over its values), then the two
    neighbouring ranks of each probability are read off the running count.
    """
    keys = list(keys)
    counts = (df.filter(F.col(value).isNotNull())
              .groupBy(*keys, F.col(value).cast("double").alias("_v"))
              .agg(F.count(F.lit(1)).alias("n")))
    ranked = cumulative(counts, keys, "_v", ["n"])
    picks = []
    for i, p in enumerate(probs.values()):
        place = F.lit(float(p)) * (F.col("total_n") - 1)
        for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            holds = (F.col("cum_n") - F.col("n") <= rank) & (rank < F.col("cum_n"))
            picks.append(F.max(F.when(holds, F.col("_v"))).alias(f"_{side}{i}"))
    agg = ranked.groupBy(*keys).agg(F.max("total_n").alias("_n"), *picks)
    out = []
    for i, (name, p) in enumerate(probs.items()):
        place = F.lit(float(p)) * (F.col("_n") - 1)
        part = place - F.floor(place)
        out.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * part).alias(name))
    return agg.select(*keys, *out)


def ks_two_sample(df: DataFrame, keys, value: str, sample: str, first, second) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per key with its asymptotic p-value:
    keys, n_first, n_second, ks_d, ks_p."""
    keys = list(keys)
    hit = lambda s: F.sum(F.when(F.col(sample) == F.lit(s), 1).otherwise(0))
    counts = (df.filter(F.col(value).isNotNull() & F.col(sample).isin(first, second))
              .groupBy(*keys, F.col(value).cast("double").alias("_v"))
              .agg(hit(first).alias("a"), hit(second).alias("b")))
    ranked = cumulative(counts, keys, "_v", ["a", "b"])
    gap = F.abs(F.try_divide(F.col("cum_a").cast("double"), F.col("total_a"))
                - F.try_divide(F.col("cum_b").cast("double"), F.col("total_b")))
    out = ranked.groupBy(*keys).agg(F.max("total_a").alias("n_first"),
                                    F.max("total_b").alias("n_second"),
                                    F.max(gap).alias("ks_d"))
    size = F.sqrt(F.try_divide(F.col("n_first").cast("double") * F.col("n_second"),
                               F.col("n_first") + F.col("n_second")))
    lam = (size + 0.12 + F.try_divide(F.lit(0.11), size)) * F.col("ks_d")
    out = out.withColumn("_lam", lam)
    sign = lambda j: F.when(j % 2 == 1, 1.0).otherwise(-1.0)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
                         lambda s, j: s + sign(j) * F.exp(-2.0 * j * j * F.col("_lam") * F.col("_lam")))
    p = F.when(F.col("_lam") < 0.2, F.lit(1.0)).otherwise(
        F.least(F.greatest(2 * series, F.lit(0.0)), F.lit(1.0)))
    return out.withColumn("ks_p", F.when(F.col("ks_d").isNotNull(), p)).drop("_lam")


def cumulative_share(df: DataFrame, keys, unit: str, value: str) -> DataFrame:
    """Ranked list with its running share of the total, largest value first:
    adds rank (1 = largest) and cum_share."""
    keys = list(keys)
    rows = df.withColumn("_order", -F.col(value)).withColumn("_one", F.lit(1))
    out = cumulative(rows, keys, "_order", [value, "_one"], tie=[unit])
    return (out.withColumn("rank", F.col("cum__one").cast("long"))
            .withColumn("cum_share", F.try_divide(F.col(f"cum_{value}"), F.col(f"total_{value}")))
            .drop("_order", "_one", "cum__one", "total__one", f"cum_{value}", f"total_{value}"))


def normal_two_sided(z: float) -> float:
    """Two-sided p-value of a standard normal statistic."""
    return math.erfc(abs(z) / math.sqrt(2.0))
