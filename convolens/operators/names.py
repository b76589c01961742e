"""Names of people: in introductions and file names, their roles, and which speaker they are."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Patterns of introductions, words that are no names, and confidences.
_NAME = r"([A-Z][a-z]+(?:\s+[A-Z]\.?\s*)?[A-Z][a-z]+)"
INTRODUCTIONS = [
    rf"(?:I'm|I am|This is|My name is)\s+{_NAME}",
    rf"(?:Welcome|Welcoming|Please welcome)\s+{_NAME}",
    rf"(?:Our guest|Today's guest|Joining us|Joined by)\s+(?:is\s+)?{_NAME}",
    rf"(?:Talking to|Speaking with|Interviewing)\s+{_NAME}",
    rf"[Hh]ost[,:\s]+{_NAME}",
    rf"[Gg]uest[,:\s]+{_NAME}",
    rf"{_NAME}(?:\s+here|,\s+here)",
    rf"{_NAME}\s+joins?\s+(?:us|the show|me)",
]
SELF_INTRODUCTIONS = [
    r"(?:i'm|i am|my name is|this is)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)",
    r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\s+here",
    r"welcome.*(?:i'm|i am)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)",
]
NO_NAMES = ("new york", "los angeles", "san francisco", "united states", "the show", "this week", "last week", "next week")
SKIP_WORDS = "episode part interview with and the a an special bonus live recap preview rerun".split()


def is_valid_name(name: Column) -> Column:
    """Two to five capitalised words of two letters or more, or initials; and none of the known false ones."""
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    good = F.forall(words, lambda w: w.rlike(r"^.\.$") | ((F.length(w) >= 2) & w.rlike(r"^\p{Lu}")))
    return F.size(words).between(2, 5) & good & ~F.lower(name).isin(*NO_NAMES)


def introduced_names(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, name, pattern_no, confidence) of all introductions in the texts."""
    def numbered(i: int):
        return lambda n: F.struct(n.alias("name"), F.lit(i).alias("pattern_no"))

    found = F.flatten(F.array(*(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), numbered(i)) for i, p in enumerate(INTRODUCTIONS))))
    out = texts.where(F.col(text).rlike("|".join(f"(?:{p})" for p in INTRODUCTIONS))).select(*keys, F.inline(found))
    return out.where(is_valid_name(F.col("name"))).withColumn("confidence", F.lit(0.85))


def distinct_names(names: DataFrame, keys: list[str]) -> DataFrame:
    """Each name once per key, whatever its case: a second method of finding it adds 0.15 (to 0.95) for every hit.

    names has method, confidence and position; the first by position gives the spelling.
    """
    n = names.withColumn("_k", F.lower(F.trim("name")))
    g = n.groupBy(*keys, "_k").agg(F.min(F.struct("position", "name", "method", "confidence")).alias("f"), F.array_sort(F.collect_list(F.struct("position", "method"))).alias("all"))
    state = F.struct(F.col("f.method").alias("m"), F.col("f.confidence").alias("c"))
    fold = F.aggregate("all", state, lambda a, x: F.when(x["method"] == a["m"], a).otherwise(F.struct(F.lit("combined").alias("m"), F.least(F.lit(0.95), a["c"] + 0.15).alias("c"))))
    return g.withColumn("r", fold).select(*keys, "f.name", F.col("r.m").alias("method"), F.round("r.c", 4).alias("confidence"), "f.position")


def title_case(word: Column) -> Column:
    """Every letter after a non-letter in upper case, the others in lower case."""
    pieces = F.regexp_extract_all(word, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substring(p, 2, 1 << 30)))), "")


def names_in_filename(filename: Column) -> Column:
    """Names in a file name: its words between skip words, in title case, if they make a valid name."""
    stem = F.regexp_replace(F.regexp_replace(filename, r"\.[^.]*$", ""), r"^\d+_?", "")
    words = F.filter(F.split(stem, r"[_\-\s]+"), lambda w: w != "")
    # skip words become separators, so runs of other words fall apart at them
    marked = F.array_join(F.transform(words, lambda w: F.when(F.lower(w).isin(*SKIP_WORDS), F.lit("|")).otherwise(w)), " ")
    groups = F.transform(F.split(marked, r"\|"), lambda g: title_case(F.trim(F.regexp_replace(g, r"\s+", " "))))
    return F.filter(groups, is_valid_name)


def first_source_names(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates (name, priority) merged whatever their case; the source of lowest priority holds."""
    w = W.partitionBy(*keys, F.lower("name")).orderBy("priority", "name")
    return candidates.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def heuristic_roles(episodes: DataFrame) -> DataFrame:
    """(episode_id, ord, name, role, confidence, reason) of each episode's names in order.

    episodes has show_title, title, intro, known_host and names. Once there is a host, a name in the show's title or a
    self-introduction no longer makes one; so the names are folded in order, inside one expression.
    """
    def step(acc, name):
        low = F.lower(name)
        host = acc["host"]
        known = F.coalesce(low == F.lower("known_host"), F.lit(False))
        in_show = ~host & F.contains(F.lower(F.replace(F.col("show_title"), F.lit("_"), F.lit(" "))), low)
        in_title = F.contains(F.lower("title"), low)
        intro = F.contains(F.lower("intro"), F.concat(F.lit("i'm "), low)) | F.contains(F.lower("intro"), F.concat(F.lit("my name is "), low))
        role = F.when(known | in_show, "HOST").when(in_title, "GUEST").when(intro, F.when(host, "GUEST").otherwise("HOST")).otherwise("GUEST")
        conf = F.when(known, 0.95).when(in_show, 0.8).when(in_title, 0.75).when(intro, 0.7).otherwise(0.5)
        why = F.when(known, "known host").when(in_show, "in podcast title").when(in_title, "in episode title").when(intro, "self-introduction").otherwise("default")
        item = F.struct(name.alias("name"), role.alias("role"), conf.alias("confidence"), why.alias("reason"))
        return F.struct((host | (role == "HOST")).alias("host"), F.concat(acc["out"], F.array(item)).alias("out"))

    empty = F.struct(F.lit(False).alias("host"), F.expr("cast(array() as array<struct<name:string,role:string,confidence:double,reason:string>>)").alias("out"))
    e = episodes.withColumns({"title": F.coalesce("title", F.lit("")), "intro": F.coalesce("intro", F.lit("")), "show_title": F.coalesce("show_title", F.lit(""))})
    return e.select("episode_id", F.posexplode(F.aggregate("names", empty, step)["out"]).alias("ord", "r")).select("episode_id", "ord", "r.*")


def fallback_roles(episodes: DataFrame) -> DataFrame:
    """The first name in the show's title is the host (0.6), all others are guests (0.4)."""
    n = episodes.select("episode_id", F.lower(F.replace(F.coalesce("show_title", F.lit("")), F.lit("_"), F.lit(" "))).alias("t"), F.posexplode("names").alias("ord", "name"))
    first = F.min(F.when(F.contains(F.col("t"), F.lower("name")), F.col("ord"))).over(W.partitionBy("episode_id"))
    return n.select("episode_id", "ord", "name", F.when(F.col("ord") == first, "HOST").otherwise("GUEST").alias("role"), F.when(F.col("ord") == first, 0.6).otherwise(0.4).alias("confidence"))


_SELF = [re.compile(p, re.I) for p in SELF_INTRODUCTIONS]
_MAPPED = "episode_id string, speaker string, name string, role string, confidence double, method string"


def _assign(host_rank: int | None, intro: int, roles: pd.DataFrame, early: pd.DataFrame, times: pd.DataFrame) -> list[tuple]:
    """Greedy assignment of one episode's names to its speakers (times: one row each, in order of appearance)."""
    texts, who = early["text"].tolist(), early["speaker"].tolist()
    order = times["speaker"].tolist()
    spent = dict(zip(order, times["time_ms"]))
    ranked = sorted(order, key=lambda s: (-spent.get(s, 0), order.index(s)))
    rank_of = {s: i for i, s in enumerate(ranked)}
    free, out, used = list(order), [], set()
    place = {"HOST": 0, "GUEST": 1}
    claims = [{m.group(1).lower() for p in _SELF if (m := p.search(t))} for t in texts[:intro]]

    def by_self(name):
        return next((who[i] for i, names in enumerate(claims) if name in names and who[i] in free), None)

    def by_other(name):
        for i, t in enumerate(texts[: 2 * intro]):
            if name in t.lower() and who[i] in free:
                nxt = next((s for s in who[i + 1 : i + 5] if s and s != who[i]), None)
                if nxt in free:
                    return nxt
        return None

    def at_rank(k):
        return next((s for s in free if rank_of[s] == k), None)

    for r in roles.sort_values(["role", "confidence", "ord"], key=lambda c: c.map(lambda v: place.get(v, 2)) if c.name == "role" else (-c if c.name == "confidence" else c), kind="stable").itertuples():
        if r.name in used or not free:
            continue
        low, c = r.name.lower(), r.confidence
        tries = [(by_self(low), min(0.9, c + 0.2), "self_introduction"), (by_other(low), min(0.85, c + 0.1), "direct_mention")]
        if r.role == "HOST" and host_rank is not None:
            tries.append((at_rank(host_rank), min(0.75, c), "cross_episode_pattern"))
        if r.role == "HOST":
            tries.append((at_rank(0), min(0.6, c), "speaking_time_rank"))
        elif r.role == "GUEST":
            tries.append((at_rank(1), min(0.5, c), "speaking_time_rank"))
        tries.append((free[0], 0.3, "fallback"))
        speaker, conf, method = next(t for t in tries if t[0] is not None)
        free.remove(speaker)
        used.add(r.name)
        out.append((speaker, r.name, r.role, round(conf, 6), method))
    return out


def show_host_ranks(candidates: DataFrame, episodes: DataFrame, least: float = 0.5) -> DataFrame:
    """(episode_id, host_rank) of the episodes of shows whose host is found by speaking time with more than ``least``; candidates as in speakers."""
    return episodes.select("episode_id", "show").distinct().join(candidates.where(F.col("score") > least).select("show", F.col("rank").alias("host_rank")), "show").select("episode_id", "host_rank")


def names_by_speaker(segments: DataFrame) -> DataFrame:
    """(episode_id, speaker, name, method, confidence, position): the names each speaker mentions, each once per speaker."""
    found = introduced_names(segments, ["episode_id", "speaker", "segment_id"])
    place = found.select("episode_id", "speaker", "name", F.concat(F.lit("pattern_"), F.col("pattern_no").cast("string")).alias("method"), "confidence", F.col("segment_id").alias("position"))
    return distinct_names(place, ["episode_id", "speaker"])


def label_speakers(episodes: DataFrame, segments: DataFrame, candidates: DataFrame) -> DataFrame:
    """The whole labelling: roles of the episodes' names, then speakers for them, with each show's own host rank."""
    return names_to_speakers(heuristic_roles(episodes), segments, show_host_ranks(candidates, episodes))


def names_to_speakers(roles: DataFrame, segments: DataFrame, host_ranks: DataFrame | None = None, intro: int = 30) -> DataFrame:
    """(episode_id, speaker, name, role, confidence, method): one speaker for each name, each speaker once.

    host_ranks (episode_id, host_rank) says which speaker by speaking time the host of an episode's show mostly is.

    Inherently sequential inside an episode, so a cogrouped pandas function; of the segments only those in the first
    2 * intro + 4 carry text, and speaking times are summed before, so an episode's group stays small.
    """
    w = W.partitionBy("episode_id").orderBy("segment_id")
    s = segments.withColumn("_i", F.row_number().over(w)).withColumn("_t", F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0)))
    early = s.where(F.col("_i") <= 2 * intro + 4).select("episode_id", "segment_id", "speaker", "text", F.lit(-1).cast("bigint").alias("time_ms"))
    times = s.groupBy("episode_id", "speaker").agg(F.min("segment_id").alias("segment_id"), F.sum("_t").alias("time_ms")).select("episode_id", "segment_id", "speaker", F.lit("").alias("text"), "time_ms")
    both = early.unionByName(times)

    def run(key, left, right):
        right = right.sort_values("segment_id")
        first = right["time_ms"] < 0
        rank = left["host_rank"].iloc[0] if len(left) else None
        rows = _assign(None if rank is None or pd.isna(rank) else int(rank), intro, left, right[first], right[~first]) if len(left) and len(right) else []
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["episode_id", "speaker", "name", "role", "confidence", "method"])

    ranked = roles.join(host_ranks, "episode_id", "left") if host_ranks is not None else roles.withColumn("host_rank", F.lit(None).cast("int"))
    return ranked.groupBy("episode_id").cogroup(both.groupBy("episode_id")).applyInPandas(run, _MAPPED)


def labeling_summary(mapped: DataFrame) -> DataFrame:
    """(dimension, value, n, avg_confidence): by method, by role, and in all."""
    g = mapped.groupingSets([["method"], ["role"], []], "method", "role").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("avg_confidence"))
    return g.select(F.when(F.col("g") == 1, "method").when(F.col("g") == 2, "role").otherwise("all").alias("dimension"), F.coalesce("method", "role", F.lit("all")).alias("value"), "n", "avg_confidence")
