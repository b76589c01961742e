"""Annotations of texts: clean-up of their enumerations, counts, rates, topics and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from convolens.functions.numbers import ratio

# The enumerations; anything else is 'other'.
TARGET_GROUPS = ("women", "lgbtq", "religious", "racial", "ethnic", "immigrants", "disabled", "political", "other")
SPEECH_TYPES = ("dehumanization", "stereotyping", "incitement", "slurs", "exclusion", "other")


def enumerated(value: Column, allowed: tuple[str, ...]) -> Column:
    """The lower-cased value if it is allowed, 'other' if not, null for null."""
    low = F.lower(F.trim(value))
    return F.when(value.isNull(), F.lit(None).cast("string")).when(low.isin(*allowed), low).otherwise(F.lit("other"))


def summary(ann: DataFrame) -> DataFrame:
    """One row: annotated texts, hateful ones, advertisements, and their rates in per cent."""
    n = F.count("*")
    return ann.agg(n.alias("n"), F.count_if("has_hate_speech").alias("n_hate"), F.count_if("has_advertisement").alias("n_ads"), F.round(ratio(F.count_if("has_hate_speech") * 100, n), 2).alias("hate_pct"), F.round(ratio(F.count_if("has_advertisement") * 100, n), 2).alias("ad_pct"))


def distributions(ann: DataFrame) -> DataFrame:
    """(dimension, value, n): target groups, types and topics; nulls and empty values are left out."""
    long = ann.select(F.expr("stack(3, 'target_group', target_group, 'hate_speech_type', hate_speech_type, 'main_topic', main_topic) as (dimension, value)"))
    return long.where("value is not null and value != ''").groupBy("dimension", "value").agg(F.count("*").alias("n"))


def hate_distributions(ann: DataFrame) -> DataFrame:
    """Target groups and types of hateful texts only."""
    return distributions(ann.where("has_hate_speech").withColumn("main_topic", F.lit(None).cast("string")))


def top_topics(ann: DataFrame, top: int = 20) -> DataFrame:
    g = ann.select(F.lower(F.trim("main_topic")).alias("topic")).where("topic is not null and topic != ''").groupBy("topic").agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), "topic").limit(top)


def dataset(ann: DataFrame) -> DataFrame:
    """Annotated rows of each episode numbered from 0 in order of doc_id."""
    return ann.where("has_hate_speech is not null").withColumn("segment_id", F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1)


def filtered(ann: DataFrame, target_group: str | None = None, speech_type: str | None = None, has_hate: bool | None = None, limit: int | None = None) -> DataFrame:
    """Annotations that match all given filters; the flag filter is null-safe, so missing is not false."""
    out = ann
    if target_group is not None:
        out = out.where(F.col("target_group") == target_group)
    if speech_type is not None:
        out = out.where(F.col("hate_speech_type") == speech_type)
    if has_hate is not None:
        out = out.where(F.col("has_hate_speech").eqNullSafe(F.lit(has_hate)))
    return out if limit is None else out.orderBy("doc_id").limit(limit)


def hate_by_source(ann: DataFrame, top: int = 10) -> DataFrame:
    """(source, n_hate, n_episodes, top_groups): where hateful texts are, and the most frequent target groups."""
    h = ann.where("has_hate_speech")
    g = h.groupBy("source").agg(F.count("*").alias("n_hate"), F.countDistinct("episode_id").alias("n_episodes"))
    t = h.where("target_group is not null").groupBy("source", "target_group").agg(F.count("*").alias("n"))
    t = t.withColumn("r", F.row_number().over(W.partitionBy("source").orderBy(F.desc("n"), "target_group"))).where(F.col("r") <= top)
    t = t.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "target_group"))), lambda x: x["target_group"]), ",").alias("top_groups"))
    return g.join(t, "source", "left")
