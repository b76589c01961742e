"""Queries on tables of features."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolens.operators import explore as X, features, speakers
from convolens.plans.base import seg
from convolens.plans.features import ORACLE as _F
from convolens.plans.speakers import _EP
from convolens.session import table

QUERIES, ORACLE = {}, {}
METRICS = ["total_turns", "dominance_index", "type_token_ratio", "average_politeness", "question_ratio"]
_f = lambda spark, d: features.episode_features(seg(spark, d))
_FEAT = "WITH f AS (" + _F["episode_features"] + ")"
_LONG = "l AS (" + " UNION ALL ".join(f"""SELECT "show", episode_id, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM f WHERE {m} IS NOT NULL""" for m in METRICS) + ")"
_X = "CAST(round(value * 1000000) AS HUGEINT)"
_STAT = f"""count(*) AS n, floor(CAST(sum({_X}) AS DOUBLE) / count(*) / 1000000 * 10000 + 0.5) / 10000 AS mean, floor(median(CAST(round(value * 1000000) AS BIGINT)) / 1000000 * 1000000 + 0.5) / 1000000 AS median,
  CASE WHEN count(*) > 1 THEN floor(sqrt(CAST(sum({_X} * {_X}) * count(*) - sum({_X}) * sum({_X}) AS DOUBLE) / (count(*) * (count(*) - 1))) / 1000000 * 1000000 + 0.5) / 1000000 END AS stdev,
  min(value) AS min, max(value) AS max, floor((max(value) - min(value)) * 1000000 + 0.5) / 1000000 AS range"""

QUERIES["feature_overview"] = lambda spark, d: X.overview(_f(spark, d), METRICS)
ORACLE["feature_overview"] = f"{_FEAT}, {_LONG} SELECT metric, {_STAT} FROM l GROUP BY 1"
QUERIES["feature_by_show"] = lambda spark, d: X.overview_by(_f(spark, d), "show", METRICS)
ORACLE["feature_by_show"] = f"""{_FEAT}, {_LONG} SELECT "show", metric, {_STAT} FROM l GROUP BY ALL"""
QUERIES["feature_correlation"] = lambda spark, d: X.correlation(_f(spark, d), "total_turns", "dominance_index")
ORACLE["feature_correlation"] = f"""{_FEAT}, c AS (SELECT count(*) AS n, round(coalesce(covar_pop(total_turns, dominance_index) / nullif(stddev_pop(total_turns) * stddev_pop(dominance_index), 0), 0), 4) AS r FROM f WHERE total_turns IS NOT NULL AND dominance_index IS NOT NULL)
SELECT n, r, CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate' WHEN abs(r) >= 0.2 THEN 'weak' ELSE 'very weak' END AS strength FROM c"""
QUERIES["feature_histogram"] = lambda spark, d: X.histogram(_f(spark, d), "total_turns")
ORACLE["feature_histogram"] = f"""{_FEAT}, e AS (SELECT min(total_turns) AS lo, max(total_turns) AS hi FROM f), b AS (SELECT CAST(least(floor((CAST(total_turns AS DOUBLE) - lo) * 20 / (hi - lo)), 19) AS INT) AS bin, count(*) AS n FROM f, e GROUP BY 1)
SELECT CAST(r.bin AS INT) AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(20)) AS bin) r LEFT JOIN b ON b.bin = r.bin"""
QUERIES["feature_ranking"] = lambda spark, d: X.ranking(_f(spark, d), "type_token_ratio", "episode_id")
ORACLE["feature_ranking"] = f"""{_FEAT} SELECT * FROM (SELECT episode_id, CAST(type_token_ratio AS DOUBLE) AS value, 'top' AS side FROM f ORDER BY value DESC, episode_id LIMIT 10)
UNION ALL SELECT * FROM (SELECT episode_id, CAST(type_token_ratio AS DOUBLE) AS value, 'bottom' AS side FROM f ORDER BY value, episode_id LIMIT 10)"""
QUERIES["feature_threshold"] = lambda spark, d: X.at_least(_f(spark, d), "total_turns", 20, "episode_id")
ORACLE["feature_threshold"] = f"{_FEAT} SELECT episode_id, CAST(total_turns AS DOUBLE) AS value FROM f WHERE total_turns >= 20 ORDER BY value DESC, episode_id LIMIT 50"
QUERIES["feature_search"] = lambda spark, d: X.find(_f(spark, d).select("show", "episode_id", "total_turns"), "VAZ", ["show", "episode_id"])
ORACLE["feature_search"] = f"""{_FEAT} SELECT "show", episode_id, total_turns FROM f WHERE contains(lower("show"), 'vaz') OR contains(lower(episode_id), 'vaz')"""
_sum = lambda spark, d: speakers.podcast_totals(seg(spark, d)).where("is_total = 0")
_SUM = f"""WITH {_EP}, s AS (SELECT "show", count(*) AS n_episodes, sum(n_words) AS n_words, sum(total_ms) AS total_ms FROM ep GROUP BY 1)"""
_SL = "l AS (" + " UNION ALL ".join(f"""SELECT "show", '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM s""" for m in ("n_episodes", "n_words", "total_ms")) + ")"
QUERIES["show_comparison"] = lambda spark, d: X.compare_shows(_sum(spark, d), ["n_episodes", "n_words", "total_ms"])
ORACLE["show_comparison"] = f"""{_SUM}, {_SL} SELECT *, round(avg(value) OVER (PARTITION BY metric), 4) AS average FROM l"""
QUERIES["show_rankings"] = lambda spark, d: X.show_rankings(_sum(spark, d), ["n_episodes", "n_words", "total_ms"])
ORACLE["show_rankings"] = f"""{_SUM}, {_SL}, r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, "show") AS rank FROM l) SELECT * FROM r WHERE rank <= 5"""
QUERIES["order_heatmap"] = lambda spark, d: X.heatmap_with_totals(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus")
ORACLE["order_heatmap"] = "SELECT o_orderpriority, o_orderstatus, grouping(o_orderpriority, o_orderstatus) AS g, count(*) AS n FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)"
QUERIES["pricing_summary"] = lambda spark, d: table(spark, d, "lineitem").where("l_shipdate <= timestamp'1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count("*").alias("n"))
ORACLE["pricing_summary"] = "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_price, round(avg(l_discount), 6) AS avg_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"
