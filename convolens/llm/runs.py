"""Runs of consecutive segments of one speaker, by pointer doubling.

Every event that continues its predecessor's run points to it; each round replaces a pointer by its pointer's pointer
(one self-join), so after log2(longest run) rounds all point to the first event of their run.

Results for odd input: of rows with the same (episode_id, segment_id), nulls being a value like any other, the one
with the latest ingested_at holds (a null ingested_at is the oldest; of ties the one with the greatest values); rows
with null, NaN or reversed times are left out after that; ties of start go by end and segment_id; null, empty and
unknown labels are one speaker; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from convolens.operators.intervals import to_ms
from convolens.session import Stage, is_empty, table

#: Events are ordered inside blocks of this many ms of an episode; only block summaries are ordered over an episode.
BLOCK_MS = 600_000
#: Groups of episodes whose events are numbered one after another.
BUCKETS = 1024
#: Words that say a speaker isn't known.
UNKNOWN = ("", "unknown", "unk", "none", "null", "nan", "n a", "na", "unidentified", "unknown speaker", "speaker unknown", "speaker", "inconnu", "unbekannt", "desconocido", "desconhecido", "sconosciuto", "неизвестно")
_PLAIN = ("áàâäãåāăéèêëēíìîïīóòôöõøōúùûüūýÿñçšžćčńłőű", "aaaaaaaaeeeeeiiiiiooooooouuuuuyyncszccnlou")


def label_key(label: Column) -> Column:
    """What a label says of the speaker: ``#n`` for a number, ``?`` for unknown, else the name without its writing."""
    x = F.regexp_replace(F.lower(label), r"\p{M}+", "")
    x = F.translate(x, *_PLAIN)
    x = F.trim(F.regexp_replace(x, r"[\s\p{Z}\p{P}\p{S}\p{C}_]+", " "))
    number = F.regexp_extract(x, r"^(?:(?:speaker|spk|sprecher|locuteur|hablante|falante|parlante|spreker|спикер|s) ?)?0*(\d{1,9})$", 1)
    return F.when(label.isNull() | x.isin(*UNKNOWN), F.lit("?")).when(number != "", F.concat(F.lit("#"), number)).otherwise(x)


def _swapped(a: Column, b: Column) -> Column:
    return (F.length(a) == F.length(b)) & (F.levenshtein(a, b) == 2) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))


def alike(a: Column, b: Column) -> Column:
    """The same key, or two names (of four letters or more) that differ by one mistyped letter."""
    names = ~a.rlike(r"^[#?]") & ~b.rlike(r"^[#?]") & (F.length(a) >= 4) & (F.length(b) >= 4)
    return (a == b) | (names & (F.abs(F.length(a) - F.length(b)) <= 1) & ((F.levenshtein(a, b, 1) >= 0) | _swapped(a, b)))


def ordered_events(stage: Stage, segments: DataFrame) -> DataFrame:
    """(episode_id, pos, segment_id, s_ms, e_ms, label, before): valid events; before is the previous label of the episode.

    pos numbers all events so that those of an episode follow each other in order; it is one number, so that joins on it
    compare and sort plain integers. Only summaries of one row a block are ordered across blocks.
    """
    latest = segments.groupBy("episode_id", "segment_id").agg(F.max(F.struct("ingested_at", "start", "end", "speaker")).alias("r"))
    ev = latest.select("episode_id", "segment_id", to_ms(F.col("r.start")).alias("s_ms"), to_ms(F.col("r.end")).alias("e_ms"), F.col("r.speaker").alias("speaker"))
    ev = ev.where("e_ms >= s_ms").select("*", label_key(F.col("speaker")).alias("label"), F.floor(F.col("s_ms") / BLOCK_MS).alias("block")).drop("speaker")
    w = W.partitionBy("episode_id", "block").orderBy("s_ms", "e_ms", "segment_id")
    ev = ev.withColumns({"rn": F.row_number().over(w), "before": F.lag("label").over(w), "_last": F.lead(F.lit(1)).over(w).isNull()})
    ev = stage.keep(ev)  # it is read twice: for the summaries, and to be joined with them
    # one row a block: how many events, and the last one's label
    blocks = ev.where("_last").select("episode_id", "block", "rn", "label", F.pmod(F.xxhash64("episode_id"), F.lit(BUCKETS)).alias("bucket"))
    w2 = W.partitionBy("bucket").orderBy("episode_id", "block")
    own = F.lag("episode_id").over(w2).eqNullSafe(F.col("episode_id")) & (F.row_number().over(w2) > 1)
    blocks = blocks.select("episode_id", "block", "bucket", "rn", F.coalesce(F.sum("rn").over(w2.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("skip"), F.when(own, F.lag("label").over(w2)).alias("carried"))
    # at most BUCKETS rows, so their running sum is one small task and the result can be sent to all
    totals = blocks.groupBy("bucket").agg(F.sum("rn").alias("k"))
    starts = totals.select("bucket", F.coalesce(F.sum("k").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    blocks = blocks.join(F.broadcast(starts), "bucket").select("episode_id", "block", (F.col("base") + F.col("skip")).alias("skip"), "carried")
    same = (F.col("e.episode_id").eqNullSafe(F.col("b.episode_id"))) & (F.col("e.block") == F.col("b.block"))
    j = ev.alias("e").join(blocks.alias("b"), same)
    return j.select("e.episode_id", (F.col("b.skip") + F.col("e.rn")).alias("pos"), "e.segment_id", "e.s_ms", "e.e_ms", "e.label", F.coalesce("e.before", F.when(F.col("e.rn") == 1, F.col("b.carried"))).alias("before"))


def two_letters_apart() -> Column:
    """Whether an event's label and the one before are names that differ by two letters; few events are like that."""
    a, b = F.col("label"), F.col("before")
    return (F.length(b) >= 4) & (F.length(a) >= 4) & ~a.rlike(r"^[#?]") & ~b.rlike(r"^[#?]") & (F.abs(F.length(a) - F.length(b)) <= 2) & (F.levenshtein(a, b, 2) == 2) & ~alike(a, b)


def _forms(name: Column) -> Column:
    """A name and the same without any one of its letters."""
    less = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.concat(name.substr(F.lit(1), i - 1), name.substr(i + 1, F.length(name))))
    return F.array_distinct(F.concat(F.array(name), less))


def _two_typos(events: DataFrame) -> DataFrame:
    """Neighbours that are two letters apart but each one letter from a third label of their episode."""
    cand = events.where(two_letters_apart()).select("episode_id", "label", "before").distinct()
    third = events.where(~F.col("label").rlike(r"^[#?]")).select("episode_id", F.col("label").alias("third")).distinct()
    # labels one letter apart share a form with at most one letter less, so the join is on equal forms
    j = cand.withColumn("form", F.explode(_forms(F.col("label")))).join(third.withColumn("form", F.explode(_forms(F.col("third")))), ["episode_id", "form"])
    return j.where(alike(F.col("label"), F.col("third")) & alike(F.col("before"), F.col("third"))).select("episode_id", "label", "before").distinct()


def pointer_doubling(stage: Stage, nodes: DataFrame) -> DataFrame:
    """nodes (pos, ptr, e_ms) are the events that continue a run, ptr being their predecessor; ptr becomes the run's first event.

    A round joins the unfinished nodes with all nodes on ptr = pos: a pointer to no node has reached a first event,
    else it becomes the pointer of the node it points to. Finished nodes are not joined again.
    """
    active = nodes.withColumn("fin", F.lit(False))
    finished: list[DataFrame] = []
    while True:
        look = active.select(F.col("pos").alias("at"), F.col("ptr").alias("to"), "fin")
        for f in finished:
            look = look.unionByName(f.select(F.col("pos").alias("at"), F.col("ptr").alias("to"), "fin"))
        j = active.drop("fin").join(look, F.col("ptr") == F.col("at"), "left")
        step = stage.keep(j.select("pos", F.coalesce("to", "ptr").alias("ptr"), "e_ms", F.coalesce("fin", F.lit(True)).alias("fin")))
        finished.append(step.where("fin"))
        active = step.where("not fin")
        if is_empty(active):
            break
    out = finished[0]
    for f in finished[1:]:
        out = out.unionByName(f)
    return out.drop("fin")


def speaker_runs(spark: SparkSession, segments: DataFrame, least: int = 2) -> DataFrame:
    """(episode_id, first_segment_id, n_segments, duration_ms) of each run of at least ``least`` (2 or more) segments."""
    stage = Stage(spark, "runs")
    events = stage.keep(ordered_events(stage, segments))
    near = F.col("before").isNotNull() & alike(F.col("label"), F.col("before"))
    linked = events.where(near).select("pos", "e_ms")
    far = events.where(two_letters_apart()).join(_two_typos(events), ["episode_id", "label", "before"], "left_semi")
    nodes = stage.keep(linked.unionByName(far.select("pos", "e_ms")).select("pos", (F.col("pos") - 1).alias("ptr"), "e_ms"))
    ends = pointer_doubling(stage, nodes)
    runs = ends.groupBy("ptr").agg((F.count("*") + 1).alias("n_segments"), F.max("e_ms").alias("last_ms")).where(F.col("n_segments") >= least)
    # the first event gives the names and, being ordered by start, the beginning
    first = events.where(~F.coalesce(near, F.lit(False))).select("episode_id", "pos", "segment_id", "s_ms", "e_ms")
    r = first.join(runs, F.col("pos") == F.col("ptr"))
    return r.select("episode_id", F.col("segment_id").alias("first_segment_id"), "n_segments", (F.greatest("last_ms", "e_ms") - F.col("s_ms")).alias("duration_ms"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speaker_runs(spark, table(spark, sf_dir, "segments").select("episode_id", "segment_id", "speaker", "start", "end", "ingested_at"))
