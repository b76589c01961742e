"""Reports as tables of lines: Markdown that is made by aggregates, so only what is read of it reaches the driver.

Results for odd input: nulls count as 'unknown'; empty tables give reports of zeros or no lines; rates of nothing are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from convolens.functions.numbers import ratio


def thousands(n: Column) -> Column:
    return F.format_number(n.cast("bigint"), 0)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """A share in per cent, half up, as text with a sign."""
    return F.concat(F.format_string(f"%.{digits}f", F.floor(ratio(part * (100 * 10**digits), whole) + 0.5) / 10**digits), F.lit("%"))


def label_report(tally: DataFrame) -> DataFrame:
    """(model_name, line_no, line): for each model a Markdown table of its labels by name; tally is (model_name, label, n)."""
    t = tally.select(F.coalesce("model_name", F.lit("unknown")).alias("model_name"), F.coalesce("label", F.lit("unknown")).alias("label"), "n")
    t = t.groupBy("model_name", "label").agg(F.sum("n").alias("n"))
    w = W.partitionBy("model_name")
    total, first = F.sum("n").over(w), F.row_number().over(w.orderBy("label"))
    rows = t.withColumns({"total": total, "no": first})
    body = rows.select("model_name", (F.col("no") + 3).alias("line_no"), F.concat(F.lit("| "), "label", F.lit(" | "), thousands(F.col("n")), F.lit(" | "), percent(F.col("n"), F.col("total")), F.lit(" |")).alias("line"))
    heads = F.array(F.concat(F.lit("**"), "model_name", F.lit("** (total: "), thousands(F.col("total")), F.lit(")")), F.lit(""), F.lit("| Label | Count | Percentage |"), F.lit("|-------|------:|------------|"))
    head = rows.where("no = 1").select("model_name", F.posexplode(heads).alias("line_no", "line"))
    return head.unionByName(body)


def read_label_report(lines: DataFrame) -> DataFrame:
    """(model_name, label, n) out of the lines of label reports; lines has model_name and line (a file's lines in any order)."""
    m = lines.select("model_name", F.regexp_extract("line", r"^\| (.*) \| ([\d,]+) \| [\d.]+% \|$", 1).alias("label"), F.regexp_replace(F.regexp_extract("line", r"^\| (.*) \| ([\d,]+) \| [\d.]+% \|$", 2), ",", "").alias("n"))
    return m.where("n != ''").select("model_name", "label", F.col("n").cast("bigint").alias("n"))


def ranked_breakdown(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, rank, value, n, pct): the values of each key, most frequent first, of ties by name."""
    g = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = W.partitionBy(*keys)
    return g.select(*keys, F.row_number().over(w.orderBy(F.desc("n"), value)).alias("rank"), value, "n", (F.floor(ratio(F.col("n") * 10000, F.sum("n").over(w)) + 0.5) / 100).alias("pct"))


def hate_report(ann: DataFrame) -> DataFrame:
    """(section, rank, value, n, pct): hateful texts by target group, type and source, most frequent first."""
    long = ann.where("has_hate_speech").select(F.expr("stack(3, 'target_group', target_group, 'hate_speech_type', hate_speech_type, 'source', source) as (section, value)")).where("value is not null")
    return ranked_breakdown(long, ["section"], "value")


def classification_summary(cls: DataFrame) -> DataFrame:
    """(model_name, rank, label, n, pct): each model's labels, most frequent first."""
    return ranked_breakdown(cls.where("model_name is not null and label is not null"), ["model_name"], "label")


def annotation_report(ann: DataFrame, files: int = 20) -> DataFrame:
    """(line_no, line): totals and rates of all annotations, then the first ``files`` sources with their numbers of texts."""
    per = ann.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"), F.count_if("has_hate_speech").alias("hate"), F.count_if("has_advertisement").alias("ads"))
    t = per.agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("hate"), F.lit(0)).alias("hate"), F.coalesce(F.sum("ads"), F.lit(0)).alias("ads"))
    row = lambda name, value: F.concat(F.lit(f"| {name} | "), value, F.lit(" |"))
    more = F.when(F.col("files") > files, F.concat(F.lit("... and "), (F.col("files") - files).cast("string"), F.lit(" more files")))
    head = F.array(
        F.lit("| Metric | Value |"), F.lit("|--------|-------|"), row("Total Files", F.col("files").cast("string")), row("Total Segments", thousands(F.col("n"))), row("Hate Speech Detected", thousands(F.col("hate"))),
        row("Advertisements Detected", thousands(F.col("ads"))), row("Hate Speech Rate", percent(F.col("hate"), F.col("n"), 2)), row("Advertisement Rate", percent(F.col("ads"), F.col("n"), 2)),
    )
    # the report shows the first sources by name only; the totals are of all
    first = per.orderBy("source").limit(files).select((F.row_number().over(W.orderBy("source")) + 99).alias("line_no"), F.concat(F.lit("- "), "source", F.lit(": "), F.col("n").cast("string"), F.lit(" segments annotated")).alias("line"))
    return t.select(F.posexplode(head).alias("line_no", "line")).unionByName(first).unionByName(t.select(F.lit(100 + files).alias("line_no"), more.alias("line")).where("line is not null"))


def metric_table(df: DataFrame, key: str, metrics: dict[str, str]) -> DataFrame:
    """(key, line_no, line): for each row of an aggregate a Markdown table of its whole-number metrics, by their titles."""
    heads = [F.concat(F.lit("# Show Summary: "), F.col(key)), F.lit(""), F.lit("| Metric | Value |"), F.lit("|--------|-------|")]
    rows = [F.concat(F.lit(f"| {title} | "), thousands(F.coalesce(c, F.lit(0))), F.lit(" |")) for c, title in metrics.items()]
    return df.select(key, F.posexplode(F.array(*heads, *rows)).alias("line_no", "line"))


def table_lines(df: DataFrame, section: str, order: list[str]) -> DataFrame:
    """(section, line_no, line): an aggregate as a Markdown section, its rows by the given columns, nulls as empty cells.

    One row of the aggregate is one line, so it should be bounded by a dimension (shows, models, labels).
    """
    cell = lambda c: F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit(""))
    head = [f"## {section}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    body = df.select((F.row_number().over(W.orderBy(*order)) + len(head) - 1).alias("line_no"), F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in df.columns)), F.lit(" |")).alias("line"))
    heads = df.sparkSession.createDataFrame(list(enumerate(head)), "line_no int, line string")
    return heads.unionByName(body).select(F.lit(section).alias("section"), "line_no", "line")


def comprehensive(sections: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(section_no, section, line_no, line): several aggregates, each with the columns that order it, as one report."""
    out = None
    for i, (name, (df, order)) in enumerate(sections.items()):
        part = table_lines(df, name, order).withColumn("section_no", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out.select("section_no", "section", "line_no", "line")


def speaker_share(speakers: DataFrame, top: int = 10) -> DataFrame:
    """(speaker, n_shows, n_words, pct): words of the leading ``top`` speakers of each show, summed over the shows, as part of all those.

    speakers is (show, speaker, n_words).
    """
    g = speakers.groupBy("show", "speaker").agg(F.sum("n_words").alias("n_words"))
    lead = g.withColumn("_r", F.row_number().over(W.partitionBy("show").orderBy(F.desc("n_words"), "speaker"))).where(F.col("_r") <= top)
    t = lead.groupBy("speaker").agg(F.count("*").alias("n_shows"), F.sum("n_words").alias("n_words"))
    # a sum over all speakers is one number, so it is joined and not made by a window over all rows
    total = lead.agg(F.sum("n_words").alias("_all"))
    return t.join(F.broadcast(total), F.lit(True)).select("speaker", "n_shows", "n_words", (F.floor(ratio(F.col("n_words") * 10000, F.col("_all")) + 0.5) / 100).alias("pct"))


def read_metric_table(lines: DataFrame, key: str) -> DataFrame:
    """(key, metric, value) out of the lines of metric tables."""
    pattern = r"^\| (.+) \| (-?[\d,]+) \|$"
    m = lines.select(key, F.regexp_extract("line", pattern, 1).alias("metric"), F.regexp_replace(F.regexp_extract("line", pattern, 2), ",", "").alias("value"))
    return m.where("metric != ''").select(key, "metric", F.col("value").cast("bigint").alias("value"))
