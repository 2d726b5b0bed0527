"""Paired permutation test and bootstrap interval.

Replicates are an extra key next to hash-drawn signs or weights. Each task adds its pairs into one
partial sum per replicate before the shuffle, so any number of pairs moves only ``replicates`` rows per task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicegate import contract
from sluicegate.functions.hashing import DRAWS


def _hash_uniform(key: Column, replicate: Column, salt: str, seed: int) -> Column:
    text = F.md5(F.concat_ws("~", key, replicate.cast("string"), F.lit(salt), F.lit(str(seed))))
    return (F.conv(F.substring(text, 1, 15), 16, 10).cast("double") + 1.0) / F.lit(float(DRAWS))


OBSERVED = 0


def _replicated(pairs: DataFrame, replicates: int) -> DataFrame:
    """Replicate 0 is the data as observed, so one pass yields the statistic and its replicates."""
    return pairs.withColumn("replicate", F.explode(F.sequence(F.lit(OBSERVED), F.lit(replicates))))


def _observed(column: str) -> Column:
    """The observed value next to every replicate: a window over ``replicates + 1`` rows."""
    return F.max(F.when(F.col("replicate") == OBSERVED, F.col(column))).over(Window.partitionBy(F.lit(0)))


def paired_permutation(
    pairs: DataFrame, key: str, difference: str, replicates: int = 200, seed: int = contract.DEFAULT_SEED
) -> DataFrame:
    """(n, mean_difference, effect_size, n_extreme, p_value) for paired differences under random signs.

    The effect size is the mean over the sample standard deviation.
    """
    flip = _hash_uniform(F.col(key).cast("string"), F.col("replicate"), "sign", seed) < 0.5
    signed = F.when((F.col("replicate") > OBSERVED) & flip, -F.col(difference)).otherwise(F.col(difference))
    one = (
        _replicated(pairs, replicates)
        .groupBy("replicate")
        .agg(F.count(difference).alias("n"), F.avg(signed).alias("mean"), F.stddev_samp(difference).alias("std"))
        .withColumns({"seen": _observed("mean"), "size": _observed("n"), "spread": _observed("std")})
    )
    # A replicate equal to the observed mean up to rounding counts as extreme.
    extreme = (F.col("replicate") > OBSERVED) & (F.abs("mean") >= F.abs("seen") - 1e-12)
    return (
        one.groupBy(F.col("size").alias("n"), F.col("seen").alias("mean_difference"), "spread")
        .agg(F.count_if(extreme).alias("n_extreme"))
        .select(
            "n",
            "mean_difference",
            F.try_divide("mean_difference", "spread").alias("effect_size"),
            "n_extreme",
            ((F.col("n_extreme") + 1) / F.lit(float(replicates + 1))).alias("p_value"),
        )
    )


def poisson_one(u: Column) -> Column:
    """A Poisson(1) count from a uniform, by its cumulative probabilities down to the resolution of the draws."""
    total, cumulative, term, k = 0.0, [], math.exp(-1), 0
    while term * DRAWS > 1:
        total += math.exp(-1) / math.factorial(k)
        cumulative.append(total)
        k += 1
        term /= k
    return sum(((u > F.lit(c)).cast("int") for c in cumulative), F.lit(0))


def bootstrap_ci(
    rows: DataFrame, key: str, value: str, replicates: int = 200, seed: int = contract.DEFAULT_SEED, level: float = 0.95
) -> DataFrame:
    """(n, mean, ci_low, ci_high) of the mean, by Poisson bootstrap."""
    drawn = _hash_uniform(F.col(key).cast("string"), F.col("replicate"), "weight", seed)
    replicated = _replicated(rows.where(F.col(value).isNotNull()), replicates).withColumn("u", drawn)
    weighted = replicated.withColumn("weight", F.when(F.col("replicate") == OBSERVED, 1).otherwise(poisson_one(F.col("u"))))
    means = weighted.groupBy("replicate").agg(
        F.count(value).alias("n"),
        F.try_divide(F.sum(F.col("weight") * F.col(value)), F.sum("weight").cast("double")).alias("mean"),
    )
    tail = (1 - level) / 2
    observed, resampled = F.col("replicate") == OBSERVED, F.when(F.col("replicate") > OBSERVED, F.col("mean"))
    return means.agg(
        F.coalesce(F.max(F.when(observed, F.col("n"))), F.lit(0)).alias("n"),
        F.max(F.when(observed, F.col("mean"))).alias("mean"),
        F.percentile(resampled, tail).alias("ci_low"),
        F.percentile(resampled, 1 - tail).alias("ci_high"),
    )
