"""Abusive, hateful and sexual content by a weighted lexicon matched with Aho-Corasick on folded text.

Folding makes one plain spelling of many: case, accents, look-alike letters of other scripts, digits and signs standing
for letters, letters spaced or dotted out, and letters masked by an asterisk. An automaton finds the cues of all
categories in it (see cues.py). Cues of one category that stand close together in a sentence are a place: the classes of
its cues add up, and so does what stands beside them in the sentence (an address, a group, "all ... are"); a phrase that
reports, denies or means something else takes off. The greatest sum in a text is its score; sums per length are given too.

Results for odd input: null, empty and blank texts have no cues and score 0; null labels, sources and languages are
kept as null; repeated rows give repeated rows; an empty lexicon leaves the cues built in; empty tables give no rows.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from convolens.llm import cues as C, transcripts
from convolens.llm.batches import slices
from convolens.llm.langid import batches_of, code_points
from convolens.operators.labels import vote as label_vote
from convolens.operators.segments import current_classifications
from convolens.session import table

CATEGORIES = ("abusive", "hateful", "sexual")
#: A sum of cues from which a text is a case; how far apart (in folded characters) cues of one sum may be, what is near, and
#: how far an exception reaches.
THRESHOLD, REACH, NEAR, FAR = 1.0, 110, 45, 70
#: The most that what stands beside cues adds, by category, and what an exception takes off.
BESIDE, EXCEPTION = {"abusive": 0.5, "hateful": 0.8, "sexual": 0.2}, 1.0
#: Words after the name of an animal or thing that tell what it is or does, so that it is meant itself.
SUBJECT = frozenset("are were have live lives is was eat spread sind waren leben ist sont étaient est vivent son eran es viven são eram é sono erano è zijn waren is leven в".split())
#: Weights of keywords that only the lexicon table has, by tier.
TIERS = {"high_confidence": 0.6, "exploratory": 0.3}

# Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
LOOKALIKES = dict(zip("аеорсухіјѕкмтвнԁһԛԝαοερτυκνιΑΒΕΖΗΙΚΜΝΟΡΤΥΧАВЕКМНОРСТУХІЈЅ", "aeopcyxijskmtbhdhqwaoeptukviabezhikmnoptyxabekmhopctyxijs"))
DIGITS = dict(zip("0134578", "oieastb"))
SIGNS = {"@": "a", "$": "s", "!": "i", "*": "*", "€": "e", "£": "l"}


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: the folded letter (0: none, 1: dropped), what a digit or sign means in a word, sentence ends."""
    fold, means, ends = np.zeros(0x110000, np.uint32), np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
    for c in range(0x20000):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind[0] == "L":
            low = ch.lower()
            if c < 0x370 or 0x1E00 <= c < 0x2000 or 0xFF00 <= c < 0xFFF0:
                low = unicodedata.normalize("NFKD", ch)[0].lower()
            low = LOOKALIKES.get(ch, LOOKALIKES.get(low, low))
            fold[c] = ord(low[0])
        elif kind == "Mn" or kind == "Cf":
            fold[c] = 1 if c < 0x370 or kind == "Cf" else c
        elif kind == "Mc":
            fold[c] = c
    for d, x in (DIGITS | SIGNS).items():
        means[ord(d)] = ord(x)
    ends[[ord(x) for x in ".!?…。！？।؟\n\r"]] = True
    return fold, means, ends


_SPACED = re.compile(r"(?<= )(?:[^\W\d_] ){2,}[^\W\d_](?= )")
_MASKED = re.compile(r"[^\W\d_*]*\*[^\W\d_]*(?:\*[^\W\d_]*)*")
_BARS = re.compile(r" ?(\|)[| ]*")


def folded(texts: list[str]) -> str:
    """All texts folded, one after another, each ended by a tab; words are parted by one space, sentences by a bar."""
    fold, means, ends = _tables()
    cps, starts = code_points(texts)
    z = fold[cps]
    odd = np.flatnonzero(means[cps])
    if len(odd):
        # signs and digits are letters in a run of letters, digits and signs that has a letter beside them
        wordy = (z > 1) | (means[cps] > 0)
        edge = np.flatnonzero(np.r_[True, wordy[1:] != wordy[:-1]])
        run = np.cumsum(np.r_[False, wordy[1:] != wordy[:-1]])
        letters = np.add.reduceat((z > 1).astype(np.int32), edge)
        sign = np.isin(cps[odd], [ord(x) for x in SIGNS])
        ok = letters[run[odd]] > 0
        after = np.minimum(odd + 1, len(z) - 1)
        ok &= ~sign | ((wordy[np.maximum(odd - 1, 0)]) & (wordy[after]))
        z[odd[ok]] = means[cps[odd[ok]]]
    end = ends[cps] & (z == 0)
    nxt = np.r_[cps[1:], 10]
    stop = end & ((cps == 10) | (nxt <= 32) | (nxt == 0xA0) | ~((cps == 46)))
    # a single line break is a wrap and no sentence end
    wrap = ((cps == 10) | (cps == 13)) & ~((nxt == 10) | (nxt == 13))
    out = np.where(z == 0, 32, z).astype(np.uint32)
    out[stop & ~wrap] = 124
    keep = z != 1
    out[starts[1:] - 1] = 9
    keep[starts[1:] - 1] = True
    gap = out == 32
    keep[1:] &= ~(gap[1:] & gap[:-1])
    out = out[keep]
    # a letter drawn out three times or more counts once
    head = np.flatnonzero(np.r_[True, out[1:] != out[:-1]])
    size = np.diff(np.r_[head, len(out)])
    drawn = (size > 2) & (out[head] > 64) & (out[head] != 124)
    if drawn.any():
        out = np.repeat(out[head], np.where(drawn, 1, size))
    return out.tobytes().decode("utf-32-le", "surrogatepass")


def _plain(phrase: str) -> str:
    return " ".join(folded([phrase]).replace("|", " ").split())


class Lexicon:
    """The automaton over all cues and exceptions."""

    def __init__(self, extra: list[tuple[str, str, str]]):
        import ahocorasick

        cues: dict[str, dict[tuple[str, str], float]] = {}
        for cat, classes in C.CUES.items():
            for kind, weight, rules in classes:
                for p in C.expanded(rules):
                    own = cues.setdefault(_plain(p), {})
                    own[cat, kind] = max(weight, own.get((cat, kind), 0.0))
        for cat, tier, keyword in extra:
            k = _plain(keyword)
            if cat in CATEGORIES and k and all(c != cat for c, _ in cues.get(k, ())):
                cues.setdefault(k, {})[cat, "table"] = TIERS.get(tier, 0.3)
        self.automaton = ahocorasick.Automaton()
        for k, what in cues.items():
            self.automaton.add_word(f" {k} ", (k, tuple((cat, kind, w) for (cat, kind), w in what.items())))
        self.automaton.make_automaton()
        self.words = {k for k in cues if " " not in k}
        # what stands beside cues: single words as sets, phrases as they are
        self.context = {cat: [(where, w, *self._split(C.expanded(rules))) for where, w, rules in rows] for cat, rows in C.CONTEXT.items()}
        self.exceptions = {cat: self._split(C.expanded(rules)) for cat, rules in C.EXCEPTIONS.items()}
        self.subject = {_plain(w) for w in SUBJECT}
        self.by_length: dict[int, list[str]] = {}
        for w in sorted({w for k in cues for w in k.split()}, key=lambda w: (w not in self.words, w)):
            self.by_length.setdefault(len(w), []).append(w)

    def _joined(self, m: re.Match) -> str:
        x = m[0].replace(" ", "")
        if x in self.words:
            return x
        for a, b in ((1, len(x)), (0, len(x) - 1), (1, len(x) - 1)):  # a one-letter word beside it
            if x[a:b] in self.words:
                return f"{x[:a]} {x[a:b]} {x[b:]}".strip()
        return x

    def _unmasked(self, m: re.Match) -> str:
        x = m[0]
        fits = re.compile(re.escape(x).replace(r"\*", "."))
        return next((w for w in self.by_length.get(len(x), ()) if fits.fullmatch(w)), x.replace("*", " "))

    def prepare(self, texts: list[str]) -> list[str]:
        """Folded texts in which spaced-out and masked words are restored and marks are spaced."""
        x = folded(texts)
        if "*" in x:
            x = _MASKED.sub(self._unmasked, x)
        x = _BARS.sub(r" | ", x)
        x = x.replace("\t", " \t ")
        return [f" {t}" for t in _SPACED.sub(self._joined, f" {x}").split("\t")[:-1]]

    @staticmethod
    def _split(phrases: list[str]) -> tuple[frozenset, tuple]:
        plain = {_plain(p) for p in phrases} - {""}
        return frozenset(p for p in plain if " " not in p), tuple(sorted(f" {p} " for p in plain if " " in p))

    def score(self, text: str) -> dict[str, tuple[float, float, int]]:
        """By category: the greatest sum of one place, the sum of all cues, and how many places are cases."""
        hits: dict[str, list[tuple[int, int, str, str, float]]] = {}
        for end, (k, what) in self._hits(text):
            for cat, kind, w in what:
                hits.setdefault(cat, []).append((end - len(k) - 1, -end, k, kind, w))
        out = {}
        for cat, found in hits.items():
            found = self._outer(sorted(found))
            best, total, cases = 0.0, 0.0, 0
            i = 0
            while i < len(found):
                j = i + 1
                while j < len(found) and found[j][0] - found[j - 1][1] <= REACH and not self._parted(text, found[j - 1][1], found[j][0]):
                    j += 1
                s, own = self._place(cat, text, found[i:j])
                total += own
                best = max(best, s)
                cases += s >= THRESHOLD - 1e-9
                i = j
            out[cat] = (best, total, cases)
        return out

    @staticmethod
    def _outer(found):
        """Cues that don't lie inside a longer one; found is sorted by start, of equal starts the longest first."""
        out, reach = [], -1
        for a, b, k, kind, w in found:
            if -b > reach or (out and (a, -b) == out[-1][:2]):
                out.append((a, -b, k, kind, w))
                reach = -b
        return out

    def _place(self, cat: str, text: str, place) -> tuple[float, float]:
        """The sum of a place with what stands beside it, and that of its cues alone."""
        classes: dict[str, dict[str, float]] = {}
        for a, b, k, kind, w in place:
            if kind == "dehuman" and text[b + 1 : b + 12].split(" ", 1)[0] in self.subject:
                w = 0.0  # the animals themselves
            classes.setdefault(kind, {})[k] = w
        own = sum(sum(sorted(x.values())[-2:]) if kind in ("insult", "table") else max(x.values()) for kind, x in classes.items())
        if own + BESIDE[cat] < THRESHOLD - 1e-9:
            return own, own
        first, last = place[0][0], place[-1][1]
        left, right = self._around(text, first, last)
        around = text[left:right] + " "
        extra = 0.0
        for where, w, words, phrases in self.context[cat]:
            if where == "just before":
                ok = any(self._ends_with(text[max(left, a - 40) : a + 1], words, phrases) for a, *_ in place[:40])
            else:
                part = around if where == "around" else text[max(left, first - NEAR) : min(right, last + NEAR)] + " " if where == "near" else text[left : first + 1]
                ok = self._has(part, words, phrases)
            extra += w if ok else 0.0
        s = own + min(BESIDE[cat], extra)
        if self._has(text[max(left, first - FAR) : min(right, last + FAR)] + " ", *self.exceptions[cat]):
            s -= EXCEPTION
        return s, own

    @staticmethod
    def _has(part: str, words: frozenset, phrases: tuple) -> bool:
        return not words.isdisjoint(part.split()) or any(p in part for p in phrases)

    @staticmethod
    def _ends_with(part: str, words: frozenset, phrases: tuple) -> bool:
        return part.rstrip(" ").rsplit(" ", 1)[-1] in words or part.endswith(phrases)

    @staticmethod
    def _parted(text: str, a: int, b: int) -> bool:
        """Whether a sentence ends between two places (a full stop after a short word may be an abbreviation's)."""
        at = text.find("|", a, b)
        while at >= 0:
            word = text[max(0, at - 12) : at].split()
            if word and len(word[-1]) > 3:
                return True
            at = text.find("|", at + 1, b)
        return False

    @staticmethod
    def _around(text: str, a: int, b: int) -> tuple[int, int]:
        """Where the sentence of a place begins and ends, at most REACH from it."""
        left, right = max(0, a - REACH), min(len(text), b + REACH)
        bar, end = text.rfind("|", left, a), text.find("|", b, right)
        return (left if bar < 0 else bar), (right if end < 0 else end + 1)

    def _hits(self, text: str):
        return self.automaton.iter(text)


@lru_cache(2)
def lexicon_of(words: tuple[tuple[str, str, str], ...]) -> Lexicon:
    """The worker's lexicon: it is made once and serves all tasks the worker runs."""
    return Lexicon(list(words))


def _run(words: list[tuple[str, str, str]]):
    def run(batches):
        lex = lexicon_of(tuple(words))
        for batch in slices(batches):
            ids, kinds = batch["doc_id"].to_pylist(), batch["kind"].to_pylist()
            texts = batches_of(batch["text"])
            for a in range(0, len(texts), 256):
                part = []
                for t, kind in zip(texts[a : a + 256], kinds[a : a + 256]):
                    if kind == "transcript" and t:
                        # what interrupts a spoken phrase goes: notes, hesitations, and fillers set off by commas
                        t = transcripts.interruptions_removed(t)
                    part.append(t)
                doc, cat, score, total, cases, length = [], [], [], [], [], []
                for k, x in enumerate(lex.prepare(part)):
                    got = lex.score(x)
                    for c in CATEGORIES:
                        s, t, n = got.get(c, (0.0, 0.0, 0))
                        doc.append(ids[a + k])
                        cat.append(c)
                        score.append(round(max(s, 0.0), 4))
                        total.append(round(t, 4))
                        cases.append(n)
                        length.append(len(texts[a + k]))
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(cat, pa.string()), pa.array(score, pa.float64()), pa.array(total, pa.float64()), pa.array(cases, pa.int32()), pa.array(length, pa.int32())], ["doc_id", "category", "score", "weight", "places", "n_chars"])

    return run


def scores(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, category, score, places, weight_per_1000, n_chars): one row per document and category.

    score is the greatest sum of cues at one place, places how many reach the threshold, weight_per_1000 all cues'
    weight per 1000 characters. The lexicon is a fixed dimension of under a hundred rows.
    """
    words = [(r.category, r.tier, r.keyword) for r in lexicon.where("keyword is not null and category is not null").select("category", "tier", "keyword", "ord").orderBy("ord").collect()]
    out = docs.select("doc_id", "kind", "text").mapInArrow(_run(words), "doc_id bigint, category string, score double, weight double, places int, n_chars int")
    return out.withColumn("weight_per_1000", F.round(F.coalesce(F.try_divide(F.col("weight") * 1000, F.col("n_chars")), F.lit(0.0)), 4)).drop("weight")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lexicon")).where("places > 0").select("doc_id", "category")


#: Models whose labels hint at a category.
HINTS = {"abusive": ["hostile_content"], "hateful": ["hate_speech_detection", "hate_against_minorities", "fine_grained_hate_speech_detection"], "sexual": ["explicit_content"]}


def hints(classifications: DataFrame) -> DataFrame:
    """(doc_id, category, hint): mean confidence, over the category's models, that the document has such content.

    A label that speaks against it counts with 1 less its confidence; models err, so this is shown beside the score and
    never decides. Repeated runs, percentages and spellings are settled as for all classifications.
    """
    c = current_classifications(classifications).where("label is not null and confidence is not null")
    category = F.lit(None).cast("string")
    for cat, models in HINTS.items():
        category = F.when(F.col("model_name").isin(*models), F.lit(cat)).otherwise(category)
    vote = label_vote(F.col("model_name"), F.col("label"), F.lit(1.0))
    against = (vote > 0) | F.upper("label").startswith("NOT") | F.upper("label").isin("CLEAN", "SAFE")
    p = F.when(against, 1 - F.col("confidence")).otherwise(F.col("confidence"))
    return c.withColumn("category", category).where("category is not null").groupBy("doc_id", "category").agg(F.round(F.avg(p), 4).alias("hint"))


def p5_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lexicon"))
    return s.join(hints(table(spark, sf_dir, "classifications")), ["doc_id", "category"], "left")


def p5_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, category, n_documents, n_cases, case_rate, mean_score): how often each source has such content."""
    docs = table(spark, sf_dir, "documents")
    s = scores(docs, table(spark, sf_dir, "lexicon")).join(docs.select("doc_id", "source"), "doc_id")
    g = s.groupBy("source", "category").agg(F.count("*").alias("n_documents"), F.count_if(F.col("places") > 0).alias("n_cases"), F.round(F.avg("score"), 6).alias("mean_score"))
    return g.withColumn("case_rate", F.round(F.col("n_cases") / F.col("n_documents"), 6))
