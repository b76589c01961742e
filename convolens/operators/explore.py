"""Statistics over a table of numeric features: overviews, correlation, histogram, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from convolens.functions.numbers import ratio


def long_form(features: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, value); rows without a number are left out."""
    args = ", ".join(f"'{m}', cast(`{m}` as double)" for m in metrics)
    return features.select(*keys, F.expr(f"stack({len(metrics)}, {args}) as (metric, value)")).where("value is not null")


#: Metrics are counted in millionths, so that sums are exact and ties round alike everywhere; buckets of a first look for a median.
UNIT, BUCKETS = 1_000_000, 1024


def rounded(value: Column, digits: int) -> Column:
    """Half up at a decimal place."""
    return F.floor(value * 10**digits + 0.5) / 10**digits


def medians(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, median) of an integer column x, exact: counts of buckets tell where the middle is, and only its buckets are looked into.

    No task sees more of a key than its bucket counts, or the counts of the different values of one bucket.
    """
    ends = values.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x").alias("lo"), (F.max("x") - F.min("x") + 1).alias("span"))
    placed = values.groupBy(*keys, "x").agg(F.count("*").alias("c")).join(ends, keys)
    placed = placed.withColumn("b", F.floor((F.col("x") - F.col("lo")) * F.lit(float(BUCKETS)) / F.col("span")))
    before = F.coalesce(F.sum("c").over(W.partitionBy(*keys).orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # the ranks of the middle, from 1: two of them where n is even
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    counts = placed.groupBy(*keys, "b", "n").agg(F.sum("c").alias("c")).withColumn("before", before)
    middle = counts.where((F.col("before") < high) & (F.col("before") + F.col("c") >= low)).select(*keys, "b", "before")
    w = W.partitionBy(*keys, "b").orderBy("x")
    inside = placed.join(middle, [*keys, "b"]).withColumn("upto", F.col("before") + F.sum("c").over(w.rowsBetween(W.unboundedPreceding, 0)))
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("x")))
    g = inside.groupBy(*keys, "n").agg(at(low).alias("a"), at(high).alias("z"))
    return g.select(*keys, ((F.col("a") + F.col("z")) / 2).alias("median"))


def _stats(long: DataFrame, keys: list[str]) -> DataFrame:
    values = long.select(*keys, "value", F.round(F.col("value") * UNIT).cast("bigint").alias("x"))
    exact = F.col("x").cast("decimal(19,0)")
    g = values.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(exact).alias("s"), F.sum(exact * exact).alias("q"), F.min("value").alias("min"), F.max("value").alias("max"))
    n, s = F.col("n").cast("decimal(12,0)"), F.col("s")
    spread = (F.col("q") * n - s.cast("decimal(19,0)") * s.cast("decimal(19,0)")).cast("double")
    stdev = F.when(F.col("n") > 1, F.sqrt(spread / (F.col("n") * (F.col("n") - 1)).cast("double")))
    out = g.join(medians(values, keys), keys)
    return out.select(*keys, "n", rounded(s.cast("double") / F.col("n") / UNIT, 4).alias("mean"), rounded(F.col("median") / UNIT, 6).alias("median"), rounded(stdev / UNIT, 6).alias("stdev"), "min", "max", rounded(F.col("max") - F.col("min"), 6).alias("range"))


def overview(features: DataFrame, metrics: list[str]) -> DataFrame:
    """Count, mean, exact median, sample deviation (null for one value), least, greatest and range of each metric, to the millionth."""
    return _stats(long_form(features, [], metrics), ["metric"])


def overview_by(features: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    return _stats(long_form(features, [key], metrics), [key, "metric"])


def correlation(features: DataFrame, x: str, y: str) -> DataFrame:
    """(n, r, strength): Pearson's r over rows with both values, 0 where either doesn't vary, null below two rows."""
    f = features.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    r = F.coalesce(F.try_divide(F.covar_pop("x", "y"), F.nullif(F.stddev_pop("x") * F.stddev_pop("y"), F.lit(0.0))), F.lit(0.0))
    g = f.agg(F.count("*").alias("n"), F.round(r, 4).alias("r0"))
    size = F.abs("r0")
    band = F.when(size >= 0.7, "strong").when(size >= 0.4, "moderate").when(size >= 0.2, "weak").otherwise("very weak")
    return g.select("n", F.when(F.col("n") >= 2, F.col("r0")).alias("r"), F.when(F.col("n") >= 2, band).alias("strength"))


def histogram(features: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, n): equal-width bins between the least and the greatest value; empty bins are 0."""
    v = features.select(F.col(column).cast("double").alias("v")).dropna()
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    b = v.join(F.broadcast(ends), F.lit(True)).select(F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))).cast("int").alias("bin"))
    every = v.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(b.groupBy("bin").agg(F.count("*").alias("n")), "bin", "left").fillna(0, ["n"])


def ranking(features: DataFrame, column: str, key: str, top: int = 10) -> DataFrame:
    """The ``top`` highest and lowest rows by a feature; of ties the first by key."""
    f = features.select(key, F.col(column).cast("double").alias("value")).dropna()
    high = f.orderBy(F.desc("value"), key).limit(top).withColumn("side", F.lit("top"))
    low = f.orderBy(F.asc("value"), key).limit(top).withColumn("side", F.lit("bottom"))
    return high.unionByName(low)


def at_least(features: DataFrame, column: str, threshold: float, key: str, top: int = 50) -> DataFrame:
    """Rows whose feature reaches a threshold; the first ``top`` by value and key."""
    return features.select(key, F.col(column).cast("double").alias("value")).where(F.col("value") >= threshold).orderBy(F.desc("value"), key).limit(top)


def find(features: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Rows where any of the columns contains the needle, whatever the case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False))
    return features.where(hit)


def compare_shows(summary: DataFrame, metrics: list[str], key: str = "show") -> DataFrame:
    """(metric, show, value, average): each metric of each show beside the mean over the shows."""
    long = long_form(summary, [key], metrics)
    return long.withColumn("average", F.round(F.avg("value").over(W.partitionBy("metric")), 4))


def show_rankings(summary: DataFrame, metrics: list[str], top: int = 5, key: str = "show") -> DataFrame:
    """(metric, rank, show, value): the leading shows by each metric."""
    long = long_form(summary, [key], metrics)
    return long.withColumn("rank", F.row_number().over(W.partitionBy("metric").orderBy(F.desc("value"), key))).where(F.col("rank") <= top)


def heatmap_with_totals(df: DataFrame, row: str, column: str) -> DataFrame:
    """(row, column, n) for every cell that occurs, with totals by row, by column and in all (nulls, by cube)."""
    return df.cube(row, column).agg(F.grouping_id().alias("g"), F.count("*").alias("n"))


def share(part: str, over: str):
    return F.round(ratio(F.col(part) * 100, F.col(over)), 2)
