"""Continuous periods and gaps of time intervals per entity, by compressed run bitmaps.

Time is discretised to whole milliseconds and cut into shards of ``SHARD_MS``. Of each (entity, shard) there is one
run bitmap: the list of its runs of set bits, ``[first, last]`` in the shard's own units. Shards form a hierarchy: the
shards that an interval fills whole are bits of a bitmap one level higher, whose unit is a shard, so an interval of any
length is at most ``2 * LEVELS - 1`` runs. Bitmaps are united twice, first inside each partition (so an entity holding
a third of all rows sends one bitmap per batch, not its rows), then per (entity, level, shard). Set runs and clear runs
are read off each bitmap; only runs touching a shard's edge need the neighbouring shards, and those are looked up over
a summary of one row per shard, or per run of whole shards.

Results for odd input: rows with null key or time, NaN, or an end not after its start don't count; repeated rows count
once by nature of a union; intervals that overlap or touch join; an empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Units of a shard, as a power of two: 2**20 ms (17.5 minutes), 2**20 shards (35 years), 2**20 of those.
BITS = 20
SHARD_MS = 1 << BITS
#: Levels of shards; together they hold every time that to_ms gives (below 2**60 ms).
LEVELS = 3


def to_ms(seconds: Column) -> Column:
    """Seconds with at most three decimals as whole milliseconds; null for null, NaN and infinities."""
    return F.when(F.abs(seconds) < 9e14, F.round(seconds * 1000).cast("bigint"))


def unite(group: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of runs [first, last] of set bits of each group: adjacent runs join. Sorted by group and first."""
    if not len(group):
        return group, first, last
    order = np.lexsort((first, group))
    group, first, last = group[order], first[order], last[order]
    edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    # running maximum of `last` inside each group: groups are lifted apart so that one accumulate serves all
    span = int(last.max() - last.min()) + 2
    rank = np.zeros(len(group), np.int64)
    rank[edge] = 1
    rank = np.cumsum(rank) - 1
    lifted = np.maximum.accumulate(last - last.min() + rank * span)
    top = lifted - rank * span + last.min()
    new = np.r_[True, (group[1:] != group[:-1]) | (first[1:] > top[:-1] + 1)]
    at = np.flatnonzero(new)
    return group[at], first[at], np.r_[top[at[1:] - 1], top[-1:]]


def _bitmaps(batches):
    """Arrow batches (ks..., shard, first, last) to one run bitmap for each (ks..., shard) of the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names
        keys = names[:-2]
        tab = pa.Table.from_batches([batch])
        codes = np.zeros(batch.num_rows, np.int64)
        for k in keys:
            enc = tab[k].combine_chunks().dictionary_encode()
            if isinstance(enc, pa.ChunkedArray):
                enc = enc.combine_chunks()
            codes = codes * (len(enc.dictionary) + 1) + enc.indices.to_numpy(zero_copy_only=False)
            _, codes = np.unique(codes, return_inverse=True)
        where = np.unique(codes, return_index=True)[1]
        g, a, b = unite(codes, tab["first"].to_numpy(), tab["last"].to_numpy())
        heads = np.searchsorted(g, np.arange(len(where)))
        offsets = pa.array(np.r_[heads, len(g)].astype(np.int32))
        runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["first", "last"]))
        yield pa.RecordBatch.from_arrays([*(tab[k].combine_chunks().take(pa.array(where)) for k in keys), runs], [*keys, "runs"])


def _islands(df: DataFrame, keys: list[str], first: str, last: str, touch: int) -> DataFrame:
    """Merged [first, last] runs per key by one sort: a run joins if it begins at most ``touch`` after all before it."""
    w = W.partitionBy(*keys).orderBy(first, last)
    before = F.max(last).over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = df.select(*keys, first, last, F.coalesce(F.col(first) > before + touch, F.lit(True)).cast("int").alias("_new"))
    marked = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min(first).alias(first), F.max(last).alias(last)).drop("_island")


def pieces(start: Column, last: Column) -> Column:
    """An interval of whole ms, last included, as array of (level, shard, first, last): partly filled shards and runs of filled ones."""
    out = []
    lo, hi = start, last  # in units of the level
    some = F.lit(True)
    for level in range(LEVELS):
        at, to = F.shiftright(lo, BITS), F.shiftright(hi, BITS)
        spot = lambda shard, a, b: F.struct(F.lit(level).alias("level"), shard.alias("shard"), a.cast("int").alias("first"), b.cast("int").alias("last"))  # noqa: B023, E731
        a, b = lo - F.shiftleft(at, BITS), hi - F.shiftleft(to, BITS)
        full = F.lit(SHARD_MS - 1)
        # shards filled from edge to edge are left to the next level; on the last one there is a shard on each side of 0
        top = F.lit(level == LEVELS - 1)
        out += [
            F.when(some & (at == to), spot(at, a, b)),
            F.when(some & (at < to) & (top | (a > 0)), spot(at, a, full)),
            F.when(some & (at < to) & (top | (b < full)), spot(to, F.lit(0), b)),
        ]
        some = some & (at < to)
        lo, hi = at + (a > 0).cast("bigint"), to - (b < full).cast("bigint")
        some = some & (lo <= hi)
    # most intervals lie in one shard
    return F.when(out[0].isNotNull(), F.array(out[0])).otherwise(F.filter(F.array(*out[1:]), lambda x: x.isNotNull()))


def run_bitmaps(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, level, shard, first, last): set runs of each shard's bitmap; df has keys, s_ms and e_ms (exclusive)."""
    clipped = df.select(*keys, F.inline(pieces(F.col("s_ms").cast("bigint"), F.col("e_ms").cast("bigint") - 1)))
    kinds = {f.name: f.dataType.simpleString() for f in clipped.schema.fields}
    part = clipped.mapInArrow(_bitmaps, ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, "level", "shard"]) + ", runs array<struct<first:int,last:int>>")
    return _islands(part.select(*keys, "level", "shard", F.inline("runs")), [*keys, "level", "shard"], "first", "last", 1)


def periods(df: DataFrame, keys: list[str]) -> DataFrame:
    """Continuous periods with the start of the next one: (keys, s_ms, e_ms, next_ms); df has keys, s_ms and e_ms."""
    # one row for each (entity, shard): its bitmap as an array of runs, bounded by the shard's width; and one for each
    # run of filled shards. A unit of the lower levels takes as many bits to the left as there are below it
    bits = F.col("level") * BITS
    base = F.shiftleft(F.col("shard"), BITS)
    runs = run_bitmaps(df, keys)
    ms = F.struct(F.call_function("shiftleft", base + F.col("first"), bits).alias("s"), F.call_function("shiftleft", base + F.col("last") + 1, bits).alias("e"))
    alone = F.when(F.col("level") > 0, F.col("first"))
    shards = runs.groupBy(*keys, "level", "shard", alone.alias("_a")).agg(F.array_sort(F.collect_list(ms)).alias("runs"))
    shards = shards.select(*keys, "level", "runs", F.col("runs")[0]["s"].alias("_lo"), F.element_at("runs", -1)["e"].alias("_hi"))
    # a shard is filled by a run of a higher level whole or not at all; what such a run fills is left out
    w = W.partitionBy(*keys).orderBy("_lo", F.desc("level"))
    filled = F.max(F.when(F.col("level") > 0, F.col("_hi"))).over(w.rowsBetween(W.unboundedPreceding, -1))
    shards = shards.withColumn("_filled", filled).where("_filled is null or _hi > _filled")
    # stitching, from the last shard to the first, so that what comes later in time was met before
    back = W.partitionBy(*keys).orderBy(F.desc("_lo"))
    shards = shards.withColumns({"_before": F.lead("_hi").over(back), "_after": F.lag("_lo").over(back)})
    n = F.size("runs")
    shards = shards.withColumns({"_entering": F.coalesce(F.col("_before") == F.col("_lo"), F.lit(False)), "_leaving": F.coalesce(F.col("_after") == F.col("_hi"), F.lit(False)), "_n": n})
    # where a period crosses edges, it ends at the first run's end in the first shard it doesn't fill and leave; the
    # next period is that shard's second run, or begins the next shard
    closing = F.when(~(F.col("_leaving") & (n == 1)), F.struct(F.col("runs")[0]["e"].alias("e"), F.when(n > 1, F.col("runs")[1]["s"]).otherwise(F.col("_after")).alias("n")))
    shards = shards.withColumn("_closing", closing)
    ahead = F.last("_closing", ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, -1))
    shards = shards.withColumn("_ahead", F.when(F.col("_leaving"), ahead).otherwise(F.struct(F.col("_hi").alias("e"), F.col("_after").alias("n"))))
    out = shards.where(~(F.col("_entering") & F.col("_leaving") & (F.col("_n") == 1))).select(*keys, "runs", "_entering", "_ahead", "_n", F.posexplode("runs").alias("_i", "_r"))
    out = out.where(~(F.col("_entering") & (F.col("_i") == 0)))
    is_last = F.col("_i") == F.col("_n") - 1
    return out.select(*keys, F.col("_r")["s"].alias("s_ms"), F.when(is_last, F.col("_ahead.e")).otherwise(F.col("_r")["e"]).alias("e_ms"), F.when(is_last, F.col("_ahead.n")).otherwise(F.try_element_at("runs", F.col("_i") + 2)["s"]).alias("next_ms"))


def periods_and_gaps(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, kind, start_ms, end_ms): a row of kind ``period`` per continuous period, ``gap`` between neighbours."""
    ready = df.select(*keys, to_ms(F.col(start)).alias("s_ms"), to_ms(F.col(end)).alias("e_ms"))
    ready = ready.dropna().where("e_ms > s_ms")
    p = periods(ready, keys)
    both = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("s_ms").alias("start_ms"), F.col("e_ms").alias("end_ms")),
        F.when(F.col("next_ms").isNotNull(), F.struct(F.lit("gap").alias("kind"), F.col("e_ms").alias("start_ms"), F.col("next_ms").alias("end_ms"))),
    )
    return p.select(*keys, F.explode(F.filter(both, lambda x: x.isNotNull())).alias("x")).select(*keys, "x.*")
