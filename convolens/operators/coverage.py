"""What each show and episode has of each processing stage, and what is still to be done."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from convolens.functions.numbers import ratio
from convolens.functions.text import is_blank

STAGES = ("transcript", "turns", "keywords", "labels")


def episode_outputs(episodes: DataFrame, **stages: DataFrame) -> DataFrame:
    """(show, episode_id, n_<stage>...): rows of each stage for every episode, 0 where it has none."""
    out = episodes.select("show", "episode_id").distinct()
    for name, df in stages.items():
        out = out.join(df.groupBy("episode_id").agg(F.count("*").alias(f"n_{name}")), "episode_id", "left")
    return out.fillna(0, [f"n_{s}" for s in stages])


def coverage(outputs: DataFrame) -> DataFrame:
    """(show, stage, total, complete, missing, pct) from episode_outputs."""
    names = [c for c in outputs.columns if c.startswith("n_")]
    args = ", ".join(f"'{n[2:]}', cast({n} > 0 as int)" for n in names)
    long = outputs.select("show", F.expr(f"stack({len(names)}, {args}) as (stage, done)"))
    g = long.groupBy("show", "stage").agg(F.count("*").alias("total"), F.sum("done").alias("complete"))
    return g.withColumns({"missing": F.greatest(F.col("total") - F.col("complete"), F.lit(0)), "pct": F.round(ratio(F.col("complete") * 100, F.col("total")), 2)})


def health(cover: DataFrame) -> DataFrame:
    """(show, health): the mean of the stages' percentages."""
    return cover.groupBy("show").agg((F.round(F.avg(F.round(F.col("pct") * 100)), 0) / 100).alias("health"))


def missing_outputs(cover: DataFrame) -> DataFrame:
    return cover.where("missing > 0").select("show", "stage", "missing")


def pending(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Items without a valid output."""
    return items.join(done.select(*keys).distinct(), keys, "left_anti")


def combined_episodes(segments: DataFrame) -> DataFrame:
    """Episodes all of whose segments have a speaker."""
    return segments.groupBy("show", "episode_id").agg(F.bool_and((F.col("speaker") != "UNKNOWN") & (F.col("speaker") != "")).alias("ok")).where("ok").select("show", "episode_id")


def postprocessed_episodes(segments: DataFrame) -> DataFrame:
    """Episodes all of whose segments have text and a speaker."""
    return segments.groupBy("show", "episode_id").agg(F.bool_and(~is_blank(F.col("text")) & (F.col("speaker") != "UNKNOWN")).alias("ok")).where("ok").select("show", "episode_id")


def embedded(vectors: DataFrame, key: str) -> DataFrame:
    """Keys all of whose rows have a vector that isn't empty."""
    return vectors.groupBy(key).agg(F.bool_and(F.coalesce(F.size("embedding"), F.lit(0)) > 0).alias("ok")).where("ok").select(key)


def classified(cls: DataFrame, docs: DataFrame, expected: list[str]) -> DataFrame:
    """Episodes whose documents with text all have labels of all expected models."""
    have = cls.groupBy("doc_id").agg(F.collect_set("model_name").alias("have"))
    j = docs.where(~is_blank(F.col("text")) & F.col("episode_id").isNotNull()).join(have, "doc_id", "left")
    ok = F.size(F.array_except(F.array(*map(F.lit, expected)), F.coalesce("have", F.expr("cast(array() as array<string>)")))) == 0
    return j.groupBy("episode_id").agg(F.bool_and(ok).alias("ok")).where("ok").select("episode_id")


def annotated(ann: DataFrame) -> DataFrame:
    """Sources all of whose annotations say whether there is hate speech."""
    return ann.groupBy("source").agg(F.bool_and(F.col("has_hate_speech").isNotNull()).alias("ok")).where("ok").select("source")


def with_stored(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """New statistics and those stored before; by key (show and episode) the new ones hold."""
    return new.unionByName(stored.join(new.select(*keys), keys, "left_anti"))


def resumed(items: DataFrame, partial: DataFrame, key: str, process) -> DataFrame:
    """What a run that was cut off has left, and ``process`` of the items it hasn't reached; columns are those of partial."""
    return partial.unionByName(process(pending(items, partial, [key])))


def changed(files: DataFrame, known: DataFrame, path: str = "path", time: str = "modificationTime") -> DataFrame:
    """Files that aren't known, or have another time than when they were read: what a memo by path and time must read again.

    A null time is never the same, so such files are read again.
    """
    seen = known.select(F.col(path).alias("_path"), F.col(time).alias("_time")).distinct()
    return files.join(seen, (F.col(path) == F.col("_path")) & (F.col(time) == F.col("_time")), "left_anti")
