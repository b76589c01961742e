"""Labels of classifiers: distributions, agreement, votes, roll-ups and gates.

Frames have (doc_id, model_name, label, confidence); the unit that a model labels is the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from convolens.functions.numbers import ratio

# What a model's label votes for; models and labels not named vote for nothing.
POLARITY = [
    ("hate_speech_detection", "NOT-HATE", 1), ("hate_speech_detection", "HATE", -1),
    ("fine_grained_hate_speech_detection", "LABEL_0", 1), ("fine_grained_hate_speech_detection", "LABEL_1", -1),
    ("fine_grained_hate_speech_detection", "LABEL_2", -1), ("fine_grained_hate_speech_detection", "LABEL_3", -1),
    ("hostile_content", "NOT-OFFENSIVE", 1), ("hostile_content", "OFFENSIVE", -1),
]
TOXIC_MODEL, TOXIC_LABEL, TOXIC_FROM = "hate_against_minorities", "toxic", 0.5
AD_MODEL, AD_LABEL = "ad_content_detection", "LABEL_1"
TOXIC_LABELS = ("toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate")
SAFE_LABELS = ("LABEL_0", "NOT-HATE", "SAFE", "APPROPRIATE")
FLAG_WORDS = ("hate", "toxic", "hostile", "offensive")


def polarity(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLARITY, "model_name string, label string, vote int")


def vote(model: Column, label: Column, confidence: Column) -> Column:
    """1, -1 or 0 for one label; the toxicity model votes by its confidence, and positively for any other label."""
    out = F.lit(0)
    for m, x, v in POLARITY:
        out = F.when((model == m) & (label == x), F.lit(v)).otherwise(out)
    toxic = F.when((label == TOXIC_LABEL) & (F.coalesce(confidence, F.lit(0.0)) >= TOXIC_FROM), F.lit(-1)).otherwise(F.lit(1))
    return F.when(model == TOXIC_MODEL, toxic).when(model == AD_MODEL, F.lit(0)).otherwise(out)


def label_distribution(cls: DataFrame) -> DataFrame:
    """(model_name, label, n, pct, n_labels): counts and shares of each model's labels."""
    g = cls.where("model_name is not null and label is not null").groupBy("model_name", "label").agg(F.count("*").alias("n"))
    w = W.partitionBy("model_name")
    return g.withColumns({"pct": F.round(F.col("n") * 100 / F.sum("n").over(w), 2), "n_labels": F.count("*").over(w)})


def confidence_histogram(cls: DataFrame, bins: int = 10) -> DataFrame:
    """(model_name, bin, n): confidences in equal bins of [0, 1]; 1 is in the last, nulls are left out, empty bins are 0."""
    g = cls.where("confidence is not null").groupBy("model_name", F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = cls.where("model_name is not null").select("model_name").distinct().select("model_name", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(g, ["model_name", "bin"], "left").fillna(0, ["n"]).withColumn("range", F.format_string("%.2f-%.2f", F.col("bin") / bins, (F.col("bin") + 1) / bins))


def model_agreement(cls: DataFrame, models: list[str]) -> DataFrame:
    """How many documents have a label of all the models, and how many of them one and the same vote."""
    if len(models) < 2:
        raise ValueError("agreement needs two models or more")
    v = cls.where(F.col("model_name").isin(*models)).select("doc_id", "model_name", vote(F.col("model_name"), F.col("label"), F.col("confidence")).alias("v"))
    d = v.groupBy("doc_id").agg(F.countDistinct("model_name").alias("m"), F.countDistinct("v").alias("k"))
    total = cls.agg(F.countDistinct("doc_id").alias("n_documents"))
    g = d.agg(F.count_if(F.col("m") == len(models)).alias("n_complete"), F.count_if((F.col("m") == len(models)) & (F.col("k") == 1)).alias("n_agree"))
    return total.join(g, F.lit(True)).withColumn("agreement_pct", F.round(ratio(F.col("n_agree") * 100, F.col("n_documents")), 2))


def label_matrix(cls: DataFrame, models: list[str]) -> DataFrame:
    """One row a document: each model's label, then each model's confidence with four decimals; models sorted."""
    g = cls.groupBy("doc_id").pivot("model_name", sorted(models)).agg(F.max("label").alias("label"), F.format_string("%.4f", F.max("confidence")).alias("confidence"))
    return g.select("doc_id", *(F.col(f"{m}_label") for m in sorted(models)), *(F.when(F.col(f"{m}_confidence") != "null", F.col(f"{m}_confidence")).alias(f"{m}_confidence") for m in sorted(models)))


def document_votes(cls: DataFrame) -> DataFrame:
    """(doc_id, is_ad, positive, negative, label): majority of each document's votes; ties are POSITIVE, none UNKNOWN.

    A document seen as an advertisement gives no votes.
    """
    v = vote(F.col("model_name"), F.col("label"), F.col("confidence"))
    g = cls.groupBy("doc_id").agg(F.max(F.coalesce((F.col("model_name") == AD_MODEL) & (F.col("label") == AD_LABEL), F.lit(False))).alias("is_ad"), F.count_if(v == 1).alias("p"), F.count_if(v == -1).alias("n"))
    g = g.select("doc_id", "is_ad", F.when(F.col("is_ad"), F.lit(0)).otherwise(F.col("p")).alias("positive"), F.when(F.col("is_ad"), F.lit(0)).otherwise(F.col("n")).alias("negative"))
    return g.withColumn("label", majority(F.col("positive"), F.col("negative")))


def majority(positive: Column, negative: Column) -> Column:
    return F.when(positive + negative == 0, "UNKNOWN").when(positive >= negative, "POSITIVE").otherwise("NEGATIVE")


def show_votes(cls: DataFrame, docs: DataFrame) -> DataFrame:
    """Per show and in total (show null): documents by label, summed votes, and the majority of the documents' labels."""
    j = document_votes(cls).join(docs.select("doc_id", "source"), "doc_id")
    g = j.rollup("source").agg(F.grouping("source").alias("is_total"), F.count_if(F.col("label") == "POSITIVE").alias("n_positive"), F.count_if(F.col("label") == "NEGATIVE").alias("n_negative"), F.count_if(F.col("label") == "UNKNOWN").alias("n_unknown"), F.count_if("is_ad").alias("n_ads"), F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))
    return g.withColumn("label", majority(F.col("n_positive"), F.col("n_negative")))


def label_tally(cls: DataFrame) -> DataFrame:
    """(model_name, label, n) with the toxicity model's label split at its threshold."""
    split = F.when((F.col("model_name") == TOXIC_MODEL) & (F.col("label") == TOXIC_LABEL), F.when(F.coalesce("confidence", F.lit(0.0)) >= TOXIC_FROM, "toxic (high conf)").otherwise("toxic (low conf)")).otherwise(F.col("label"))
    return cls.where("label is not null").groupBy("model_name", split.alias("label")).agg(F.count("*").alias("n"))


def classification_rollup(cls: DataFrame, docs: DataFrame) -> DataFrame:
    """(level, source, episode_id, model_name, label, n): label counts for all, by show, and by episode of a show."""
    j = cls.where("model_name is not null and label is not null").join(docs.select("doc_id", "source", "episode_id"), "doc_id")
    g = j.groupingSets([["model_name", "label"], ["source", "model_name", "label"], ["source", "episode_id", "model_name", "label"]], "source", "episode_id", "model_name", "label").agg(F.grouping("source").alias("gs"), F.grouping("episode_id").alias("ge"), F.count("*").alias("n"))
    return g.select(F.when(F.col("gs") == 1, "all").when(F.col("ge") == 1, "show").otherwise("episode").alias("level"), "source", "episode_id", "model_name", "label", "n")


def corpus_statistics(cls: DataFrame, docs: DataFrame) -> DataFrame:
    """Shows, episodes, documents, classified documents and models."""
    d = docs.agg(F.countDistinct("source").alias("n_shows"), F.countDistinct("episode_id").alias("n_episodes"), F.count("*").alias("n_documents"))
    c = cls.agg(F.countDistinct("doc_id").alias("n_classified"), F.countDistinct("model_name").alias("n_models"))
    return d.join(c, F.lit(True))


def show_coverage(docs: DataFrame) -> DataFrame:
    """Per show: episodes, documents and documents an episode, most episodes first."""
    g = docs.groupBy("source").agg(F.countDistinct("episode_id").alias("n_episodes"), F.count("*").alias("n_documents"))
    return g.withColumns({"per_episode": F.round(ratio(F.col("n_documents"), F.col("n_episodes")), 2), "rank": F.row_number().over(W.orderBy(F.desc("n_episodes"), "source"))})


def document_sentiment(cls: DataFrame) -> DataFrame:
    """Per document: negative if a hostile, toxic or hateful label is there, else positive if NOT-HATE, else neutral."""
    m, x = F.col("model_name"), F.col("label")
    hostile, toxic = (m == "hostile_content") & (x == "OFFENSIVE"), (m == TOXIC_MODEL) & x.isin(*TOXIC_LABELS)
    hate, safe = (m == "hate_speech_detection") & (x == "HATE"), (m == "hate_speech_detection") & (x == "NOT-HATE")
    g = cls.groupBy("doc_id").agg(F.count_if(hostile).alias("n_hostile"), F.count_if(toxic).alias("n_toxic"), F.max(F.coalesce(hostile | toxic | hate, F.lit(False))).alias("neg"), F.max(F.coalesce(safe, F.lit(False))).alias("pos"))
    return g.select("doc_id", "n_hostile", "n_toxic", F.when(F.col("neg"), "negative").when(F.col("pos"), "positive").otherwise("neutral").alias("sentiment"))


def sentiment_by_show(cls: DataFrame, docs: DataFrame) -> DataFrame:
    j = document_sentiment(cls).join(docs.select("doc_id", "source"), "doc_id")
    n = F.count("*")
    return j.groupBy("source").agg(n.alias("n_documents"), F.count_if(F.col("sentiment") == "negative").alias("n_negative"), F.count_if(F.col("sentiment") == "positive").alias("n_positive"), F.count_if(F.col("sentiment") == "neutral").alias("n_neutral"), F.sum("n_hostile").alias("n_hostile"), F.round(F.sum("n_hostile") * 100 / n, 2).alias("hostile_pct"))


def problematic_flags(cls: DataFrame, docs: DataFrame) -> DataFrame:
    """Per show the labels that contain a flag word (NOT-HATE contains one too, as the definition has it)."""
    flagged = cls.where(F.exists(F.array(*map(F.lit, FLAG_WORDS)), lambda f: F.contains(F.lower("label"), f)))
    return flagged.join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "model_name", "label").agg(F.count("*").alias("n"))


def annotation_gate(cls: DataFrame, least: int = 2) -> DataFrame:
    """(doc_id, is_ad, n_negative, annotate, skip_reason): which documents go on to the annotator, and why others don't."""
    g = cls.groupBy("doc_id").agg(F.max(F.coalesce((F.col("model_name") == AD_MODEL) & (F.col("label") == AD_LABEL), F.lit(False))).alias("is_ad"), F.count_if(vote(F.col("model_name"), F.col("label"), F.coalesce("confidence", F.lit(0.0))) == -1).alias("n_negative"))
    reason = F.when(F.col("is_ad"), "advertisement").when(F.col("n_negative") < least, "insufficient_negative_labels")
    return g.select("doc_id", "is_ad", "n_negative", (~F.col("is_ad") & (F.col("n_negative") >= least)).alias("annotate"), reason.alias("skip_reason"))


def missing_models(cls: DataFrame, docs: DataFrame, expected: list[str]) -> DataFrame:
    """(doc_id, missing): expected models that a document with text has no label of, where there are any."""
    have = cls.groupBy("doc_id").agg(F.collect_set("model_name").alias("have"))
    j = docs.join(have, "doc_id", "left").select("doc_id", F.array_except(F.array(*map(F.lit, expected)), F.coalesce("have", F.expr("cast(array() as array<string>)"))).alias("m"))
    return j.where(F.size("m") > 0).select("doc_id", F.array_join(F.array_sort("m"), ",").alias("missing"))


def merged(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Classifications of both frames by (doc_id, model_name); the new ones hold where both have one."""
    both = existing.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    g = both.groupBy("doc_id", "model_name").agg(F.max_by(F.struct("label", "confidence"), "_v").alias("r"))
    return g.select("doc_id", "model_name", "r.label", "r.confidence")


def top_labels(cls: DataFrame, top: int = 10, without_safe: bool = False) -> DataFrame:
    """The most frequent labels of each model; of ties the first by name."""
    c = cls.where("label is not null")
    if without_safe:
        c = c.where(~F.upper("label").isin(*SAFE_LABELS))
    g = c.groupBy("model_name", "label").agg(F.count("*").alias("n"))
    return g.withColumn("rank", F.row_number().over(W.partitionBy("model_name").orderBy(F.desc("n"), "label"))).where(F.col("rank") <= top)


def coverage_check(cls: DataFrame, docs: DataFrame, complete: int) -> DataFrame:
    """(text, labels, n): documents with and without text by no label, some, or ``complete``; with subtotals (cube)."""
    n = cls.groupBy("doc_id").agg(F.countDistinct("model_name").alias("k"))
    j = docs.join(n, "doc_id", "left").select(F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty").otherwise("text").alias("text"), F.when(F.coalesce("k", F.lit(0)) == 0, "none").when(F.col("k") >= complete, "complete").otherwise("some").alias("labels"))
    return j.cube("text", "labels").agg(F.count("*").alias("n")).select(F.coalesce("text", F.lit("all")).alias("text"), F.coalesce("labels", F.lit("all")).alias("labels"), "n")
