"""Similarity of vectors to a taxonomy, with diagnostics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of a taxonomy that are sent to all tasks at a time; vectors multiplied at a time.
BLOCK, ROWS = 20_000, 2_048


def centroids(vectors: DataFrame, key: str) -> DataFrame:
    """(key, vector): the mean vector of each key."""
    long = vectors.where(F.col("embedding").isNotNull()).select(key, F.posexplode("embedding").alias("i", "x"))
    g = long.groupBy(key, "i").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("x"))
    return g.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select(key, F.transform("v", lambda e: e["x"]).alias("vector"))


def _products(broadcast, threshold: float, kind: pa.DataType):
    """Arrow batches (vec_id, embedding) to their matches, by one matrix product for each slice of rows."""

    def run(batches):
        labels, units = broadcast.value
        label_array = pa.array(labels, kind)
        size = units.shape[1] if len(units) else 0
        for batch in batches:
            lists = batch["embedding"]
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            fit = np.flatnonzero(lengths == size) if size else np.zeros(0, np.int64)
            for i in range(0, len(fit), ROWS):
                rows = fit[i : i + ROWS]
                values = lists.take(pa.array(rows)).flatten()
                x = pc.fill_null(values.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False).reshape(-1, size)
                length = np.sqrt((x * x).sum(1))
                with np.errstate(invalid="ignore", divide="ignore"):
                    dots = np.round((x / length[:, None]) @ units.T, 6)
                at, to = np.nonzero(dots >= threshold)  # no number is not at least anything
                yield pa.RecordBatch.from_arrays([batch["vec_id"].take(pa.array(rows[at])), label_array.take(pa.array(to)), pa.array(dots[at, to])], ["vec_id", "label", "similarity"])

    return run


def threshold_matches(vectors: DataFrame, taxonomy: DataFrame, threshold: float) -> DataFrame:
    """(vec_id, label, similarity) of all pairs with a cosine of at least ``threshold``.

    Vectors without length, with nulls or of another length than the taxonomy's match nothing. The taxonomy is a stated
    query set against all rows, in blocks of about ``BLOCK`` rows; the unit vectors of a block are sent to all tasks.
    """
    spark = vectors.sparkSession
    t = taxonomy.where("vector is not null").select("label", "vector")
    blocks = max(1, -(-t.count() // BLOCK))
    label = taxonomy.schema["label"].dataType
    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, label {label.simpleString()}, similarity double"
    out = spark.createDataFrame([], schema)
    for b in range(blocks):
        rows = t.where(F.pmod(F.xxhash64("label"), F.lit(blocks)) == b).orderBy("label").collect()
        size = max((len(r.vector) for r in rows), default=0)
        rows = [r for r in rows if len(r.vector) == size and None not in r.vector]
        m = np.array([r.vector for r in rows], float).reshape(len(rows), size)
        length = np.sqrt((m * m).sum(1))
        m /= np.where(length == 0, 1.0, length)[:, None]
        sent = spark.sparkContext.broadcast(([r.label for r in rows], m))
        out = out.unionByName(vectors.select("vec_id", "embedding").mapInArrow(_products(sent, threshold, to_arrow_type(label)), schema))
    return out


def similarity_summary(matches: DataFrame) -> DataFrame:
    """(label, n, avg_similarity), the label null for all."""
    return matches.rollup("label").agg(F.grouping("label").alias("is_total"), F.count("*").alias("n"), F.round(F.avg("similarity"), 3).alias("avg_similarity"))


def similarity_diagnostics(matches: DataFrame) -> DataFrame:
    """Lowest, highest and mean of the vectors' best similarities."""
    best = matches.groupBy("vec_id").agg(F.max("similarity").alias("s"))
    return best.agg(F.min("s").alias("lowest"), F.max("s").alias("highest"), F.round(F.avg("s"), 6).alias("mean"))


def taxonomy_texts(groups: DataFrame, strategies: DataFrame, examples: DataFrame, most: int = 10) -> DataFrame:
    """(target_group_id, strategy_id, text, example_count): every group with every strategy, described and exemplified."""
    e = examples.groupBy("target_group_id", "strategy_id").agg(F.array_sort(F.collect_list(F.struct("ord", "item"))).alias("items"))
    pairs = groups.select(F.col("id").alias("target_group_id")).join(F.broadcast(strategies.select(F.col("id").alias("strategy_id"), "description")), F.lit(True))
    j = pairs.join(e, ["target_group_id", "strategy_id"], "left")
    first = F.array_join(F.transform(F.slice("items", 1, most), lambda x: x["item"]), " ")
    return j.select("target_group_id", "strategy_id", F.concat_ws(" ", "description", first).alias("text"), F.coalesce(F.size("items"), F.lit(0)).alias("example_count"))
