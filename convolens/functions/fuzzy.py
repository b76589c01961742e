"""Fuzzy matching of titles and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from convolens.functions.numbers import ratio

# Abbreviations and words left out, in their order, and the weights of the parts.
ABBREVIATIONS = {
    "npr": "national public radio", "bbc": "british broadcasting corporation", "nyt": "new york times", "wsj": "wall street journal",
    "pbs": "public broadcasting service", "abc": "american broadcasting company", "cbs": "columbia broadcasting system", "nbc": "national broadcasting company",
    "cnn": "cable news network", "msnbc": "microsoft national broadcasting company", "pod": "podcast", "ep": "episode", "pts": "parts", "pt": "part",
    "ft": "featuring", "w/": "with", "vs": "versus", "&": "and",
}
FUZZY_STOPWORDS = """
the a an and or but in on at to for of with by from is are was were be been being have has had do does did will would
could should may might must shall can that this these those it its podcast show episode
""".split()
WEIGHTS = {"word": 0.4, "char": 0.3, "phonetic": 0.2, "position": 0.1}


def normalize_title(text: Column, expand: bool = True) -> Column:
    x = F.lower(F.coalesce(text, F.lit("")))
    if expand:
        for short, long in ABBREVIATIONS.items():
            # a word boundary on either side of a sign means that a word character touches it
            left = r"(?<![\p{L}\p{N}_])" if short[0].isalnum() else r"(?<=[\p{L}\p{N}_])"
            right = r"(?![\p{L}\p{N}_])" if short[-1].isalnum() else r"(?=[\p{L}\p{N}_])"
            x = F.regexp_replace(x, left + short + right, long)
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def title_words(text: Column, least: int = 2) -> Column:
    return F.filter(F.split(normalize_title(text), " "), lambda w: (F.length(w) >= least) & ~w.isin(*FUZZY_STOPWORDS))


def soundex(word: Column) -> Column:
    """A letter and three digits; vowels don't part equal codes. '0000' if there is no letter."""
    w = F.regexp_replace(F.upper(F.coalesce(word, F.lit(""))), "[^A-Z]", "")
    codes = F.translate(w, "BFPVCGJKQSXZDTLMNRAEHIOUWY", "111122222222334556")
    runs = F.regexp_replace(codes, r"(.)\1+", "$1")
    rest = F.when(F.left(w, F.lit(1)).rlike("[AEHIOUWY]"), runs).otherwise(F.substring(runs, 2, 1 << 30))
    return F.when(w == "", F.lit("0000")).otherwise(F.left(F.concat(F.left(w, F.lit(1)), rest, F.lit("000")), F.lit(4)))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.coalesce(F.length(a), F.lit(0)) == 0) | (F.coalesce(F.length(b), F.lit(0)) == 0), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def word_match(query: Column, target: Column) -> Column:
    return ratio(F.size(F.filter(query, lambda w: F.array_contains(target, w))), F.size(query))


def position_match(query: Column, target: Column) -> Column:
    weights = F.transform(query, lambda w, i: F.lit(1.0) / (i + 1))
    gained = F.transform(query, lambda w, i: F.when(F.array_contains(target, w), F.lit(1.0) / (i + 1) / (F.abs(i + 1 - F.array_position(target, w)) + 1)).otherwise(F.lit(0.0)))
    add = lambda s, x: s + x
    return ratio(F.aggregate(gained, F.lit(0.0), add), F.aggregate(weights, F.lit(0.0), add))


def prepared(text: Column) -> Column:
    """What scoring needs of one side, to be computed once per row before any join: words, their codes, plain text."""
    words = title_words(text)
    return F.struct(words.alias("words"), F.transform(words, soundex).alias("codes"), normalize_title(text).alias("plain"))


def parts_of(q: Column, t: Column) -> dict[str, Column]:
    """The four partial scores of two prepared sides."""
    return {"word": word_match(q["words"], t["words"]), "char": levenshtein_ratio(q["plain"], t["plain"]), "phonetic": word_match(q["codes"], t["codes"]), "position": position_match(q["words"], t["words"])}


def score_of(q: Column, t: Column) -> Column:
    """Weighted sum of the partial scores of two prepared sides; 0 if either has no significant word."""
    parts = parts_of(q, t)
    total = sum((parts[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))
    some = (F.size(q["words"]) > 0) & (F.size(t["words"]) > 0)
    return F.when(some, F.least(total, F.lit(1.0))).otherwise(F.lit(0.0))


def explanation_of(q: Column, t: Column) -> Column:
    """Why two prepared sides match."""
    parts = parts_of(q, t)
    words = F.when(parts["word"] > 0.3, F.concat(F.lit("matched words: "), F.array_join(F.filter(q["words"], lambda w: F.array_contains(t["words"], w)), ", ")))
    sound = F.when(parts["phonetic"] > parts["word"], F.lit("phonetic similarity detected"))
    order = F.when(parts["position"] > 0.5, F.lit("good word ordering"))
    said = F.concat_ws("; ", words, sound, order)
    return F.when(F.size(q["words"]) == 0, F.lit("no significant words in query")).when(F.size(t["words"]) == 0, F.lit("no significant words in target")).when(said == "", F.lit("low match confidence")).otherwise(said)


def fuzzy_score(query: Column, target: Column) -> Column:
    return score_of(prepared(query), prepared(target))


def explanation(query: Column, target: Column) -> Column:
    return explanation_of(prepared(query), prepared(target))


def query_variations(query: Column) -> Column:
    """The query and up to six other ways to ask for it, each once, in order."""
    low, plain = F.lower(query), normalize_title(query, expand=False)
    first = F.lower(F.split(F.trim(query), r"\s+")[0])
    without = F.trim(F.regexp_replace(query, r"(?i)\s*podcast\s*", " "))
    ways = F.array(
        query,
        F.when(plain != low, plain),
        normalize_title(query),
        F.when(~low.contains("podcast"), F.concat(query, F.lit(" podcast"))),
        F.when(low.contains("podcast") & (without != ""), without),
        F.when(low.startswith("the ") & (F.length(query) > 4), F.substring(query, 5, 1 << 30)),
        F.when(~first.isin("the", "a", "an") & (F.trim(query) != ""), F.concat(F.lit("the "), query)),
    )
    return F.array_distinct(F.filter(ways, lambda x: x.isNotNull()))


def tokens_match(a: Column, b: Column) -> Column:
    """Whether two titles share more than half of the shorter one's words."""
    x, y = (F.array_distinct(F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")) for t in (a, b))
    return ratio(F.size(F.array_intersect(x, y)), F.least(F.size(x), F.size(y))) > 0.5


def video_confidence(episode_title: Column, episode_duration: Column, show: Column, title: Column, channel: Column, duration: Column) -> Column:
    """How likely a video is an episode: show named (0.4), title words (0.4), duration (0.2)."""
    t, s = F.lower(title), F.lower(show)
    named = F.when(t.contains(s) | F.lower(channel).contains(s), F.lit(0.4)).when(F.exists(F.split(s, r"\s+"), lambda w: (F.length(w) > 3) & t.contains(w)), F.lit(0.2)).otherwise(F.lit(0.0))
    wanted = F.filter(F.split(F.lower(episode_title), r"\s+"), lambda w: F.length(w) > 2)
    words = ratio(F.size(F.filter(wanted, lambda w: F.array_contains(F.split(t, r"\s+"), w))), F.size(wanted)) * 0.4
    off = F.abs(episode_duration - duration)
    length = F.when((episode_duration > 0) & (duration > 0), F.when(off <= episode_duration * 0.1, F.lit(0.2)).when(off <= episode_duration * 0.25, F.lit(0.1))).otherwise(F.lit(0.0))
    return F.least(named + F.coalesce(words, F.lit(0.0)) + F.coalesce(length, F.lit(0.0)), F.lit(1.0))


#: Error categories by the words that tell them, in order.
ERRORS = [
    ("timeout", ["timeout", "timed out"]), ("network", ["connection", "network", "ssl"]), ("not_found", ["404", "not found"]), ("permission", ["403", "forbidden", "blocked"]),
    ("validation", ["validation", "invalid", "corrupt"]), ("rate_limit", ["rate limit", "429", "quota"]),
]


def error_category(message: Column) -> Column:
    low = F.lower(message)
    out = F.lit("unknown")
    for name, words in reversed(ERRORS):
        out = F.when(low.rlike("|".join(words)), F.lit(name)).otherwise(out)
    return out


def http_category(status: Column) -> Column:
    return F.when(status == 404, "not_found").when(status == 403, "permission").when(status == 429, "rate_limit").when(status.between(400, 499), "client").when(status.between(500, 599), "network").otherwise("http")
