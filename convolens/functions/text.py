"""Words, sentences, questions, politeness and name clean-up as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: White space as Unicode-aware splitting sees it; the same class in Java and RE2.
SPACE = r"\x09-\x0D\x1C-\x20\x85\p{Z}"

# Word lists and weights that results must equal.
STOPWORDS = """
a an the and or but in on at to for of with by from as is was are were been be have has had do does did will would
could should may might must shall can need dare ought used it its this that these those i me my myself we our ours
ourselves you your yours yourself yourselves he him his himself she her hers herself they them their theirs themselves
what which who whom when where why how all each every both few more most other some such no nor not only own same so
than too very just also now here there then once if because until while about against between into through during
before after above below up down out off over under again further any being having doing am going get got like know
think yeah yes no okay ok um uh well right mean really actually basically literally thing things something anything
nothing everything someone anyone everyone nobody everybody
""".split()
QUESTION_STARTERS = "who what when where why how is are was were do does did can could will would should have has had".split()
ADDRESS_PRONOUNS = "you your yours yourself you're youre you'll youll you'd youd you've youve".split()
ADDRESS_OPENERS = "why what how when where who can could do did will would are were should have had won't wont don't dont is".split()
ADDRESS_IMPERATIVES = "tell explain look listen imagine remember consider try check answer".split()
POLITENESS_BIAS = -0.219798
#: Strategy: weight, and how it is seen in the lower-cased text.
POLITENESS = {
    "Gratitude": 2.11927, "Please": 1.31409, "Please_start": -1.71990, "Apologizing": 1.50141, "Hedges": 0.61410,
    "Direct_question": -1.18020, "2nd_person": -0.04706, "1st_person": 0.27582, "1st_person_pl.": 0.21695,
}
GRATITUDE = "thank thanks appreciate".split()
APOLOGIES = "sorry apologize apologies".split()
HEDGES = ["maybe", "perhaps", "possibly", "might", "could", "i think", "i guess"]
PERSONS = {"2nd_person": "you your yours".split(), "1st_person": "i my me mine".split(), "1st_person_pl.": "we our us ours".split()}
#: Weights of the full strategy set, for counts that an outside parser supplies.
STRATEGY_WEIGHTS = POLITENESS | {
    "Deference": 1.22837, "Greeting": 0.77941, "Positive": 0.68555, "Negative": -1.14790, "Indirect_(btw)": 1.18813, "Factuality": -1.04980,
    "1st_person_start": 0.01042, "2nd_person_start": -0.43240, "Direct_start": -1.54560, "Counterfactual_modal": 0.94153, "Indicative_modal": 0.35432,
}


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def is_blank(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit(""))) == ""


def tokens(text: Column) -> Column:
    """White-space separated words; none for null and blank text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"([^{SPACE}]+)"), F.lit(1))


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+")).cast("bigint")


def vocabulary_words(text: Column) -> Column:
    """Runs of unaccented letters and apostrophes in the lower-cased text that no other letter or digit touches."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?<![\p{L}\p{N}\p{M}_])(?=[a-z'])('*[a-z][a-z']*)(?![\p{L}\p{N}\p{M}_])"), F.lit(1))


def sentences(text: Column) -> Column:
    """Pieces between full stop, exclamation or question mark and white space, stripped, empty ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), f"(?<=[.!?])[{SPACE}]+"), strip), lambda s: s != "")


def is_question(sentence: Column) -> Column:
    s = strip(sentence)
    return s.rlike(r"\?$") | s.rlike(r"(?i)^(?:" + "|".join(QUESTION_STARTERS) + r")(?![\p{L}\p{N}_])")


def is_direct_address(text: Column) -> Column:
    """Second-person pronouns, a question word before "you", or an opening imperative."""
    edge = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
    pronoun = edge[0] + "(?:" + "|".join(ADDRESS_PRONOUNS) + ")" + edge[1]
    opener = edge[0] + "(?:" + "|".join(ADDRESS_OPENERS) + ")" + edge[1] + r"[\s,;:—-]+you" + edge[1]
    imperative = r"^\s*(?:" + "|".join(ADDRESS_IMPERATIVES) + ")" + edge[1]
    return text.rlike(f"(?i)(?:{pronoun}|{opener}|{imperative})")


def _any_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def politeness_strategies(text: Column) -> dict[str, Column]:
    """Strategy name to whether the text shows it."""
    low = F.lower(text)
    words = tokens(low)
    seen = {
        "Gratitude": _any_of(low, GRATITUDE), "Please": low.contains("please"), "Please_start": strip(low).startswith("please"),
        "Apologizing": _any_of(low, APOLOGIES), "Hedges": _any_of(low, HEDGES), "Direct_question": strip(text).endswith("?"),
    }
    return seen | {k: F.arrays_overlap(words, F.array(*map(F.lit, v))) for k, v in PERSONS.items()}


def politeness_score(text: Column) -> Column:
    parts = politeness_strategies(text)
    return reduce(lambda a, b: a + b, (F.when(c, F.lit(POLITENESS[k])).otherwise(F.lit(0.0)) for k, c in parts.items()), F.lit(POLITENESS_BIAS))


def weighted_strategies(counts: Column) -> Column:
    """Bias plus weight times count of a MAP<STRING, BIGINT> of strategies; unknown strategies weigh nothing."""
    weights = F.create_map(*(x for k, v in STRATEGY_WEIGHTS.items() for x in (F.lit(k), F.lit(v))))
    return F.aggregate(F.map_entries(counts), F.lit(POLITENESS_BIAS), lambda a, e: a + F.coalesce(F.try_element_at(weights, e["key"]), F.lit(0.0)) * e["value"])


def normalized(text: Column) -> Column:
    """Lower case, letters a-z, digits and single spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"[^a-z0-9{SPACE}]", ""), f"[{SPACE}]+", " "))


def sanitize_name(name: Column, max_length: int | None = None) -> Column:
    """A file-name form: lower case, other signs and white space as single underscores; 'untitled' if nothing is left."""
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9\s]", "_"), r"\s+", "_"), "_+", "_")
    x = F.regexp_replace(x, "^_+|_+$", "")
    if max_length is not None:
        x = F.regexp_replace(F.left(x, F.lit(max_length)), "_+$", "")
    return F.when(x == "", F.lit("untitled")).otherwise(x)


def extract_show_name(path: Column) -> Column:
    """The last but one part of a path of three or more parts, else 'unknown'."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 3, F.element_at(parts, -2)).otherwise(F.lit("unknown"))


def strip_markup(text: Column) -> Column:
    """Without [tags] of console mark-up."""
    return F.regexp_replace(text, r"\[/?[^\]]+\]", "")


def highlight(text: Column, keyword: str) -> Column:
    return F.regexp_replace(text, f"(?i)({_quoted(keyword)})", "[$1]")


def snippet(text: Column, pattern: str, window: int = 50) -> Column:
    """The first match with ``window`` characters on both sides and dots where the text goes on."""
    at = F.regexp_instr(text, F.lit(pattern))
    size = F.length(F.regexp_substr(text, F.lit(pattern)))
    begin, end = F.greatest(at - window, F.lit(1)), F.least(at + size + window, F.length(text) + 1)
    return F.concat(F.when(begin > 1, F.lit("...")).otherwise(F.lit("")), text.substr(begin, end - begin), F.when(end <= F.length(text), F.lit("...")).otherwise(F.lit("")))


def truncated(text: Column, width: int = 100) -> Column:
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width - 3)), F.lit("..."))).otherwise(text)


def _quoted(literal: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+?^$|" else c for c in literal)


def keyword_pattern(keyword: Column, partial: bool = False) -> Column:
    """A case-insensitive pattern for a literal keyword, as a whole word unless ``partial``."""
    q = F.regexp_replace(keyword, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    return F.concat(F.lit("(?iu)"), q) if partial else F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}\p{M}_])"), q, F.lit(r"(?![\p{L}\p{N}\p{M}_])"))


def paragraph(text: Column, width: int = 80) -> Column:
    """White space collapsed, and lines of at most ``width`` characters; longer words are cut."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " "))
    lines = F.regexp_replace(flat, f"(.{{1,{width}}})(?: |$)|(.{{{width}}})", "$1$2\n")
    return F.regexp_replace(lines, "\n$", "")
