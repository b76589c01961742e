"""Languages of documents and of stretches of documents: multinomial naive Bayes over hashed character n-grams.

Texts are code point arrays; letters are folded and lower-cased, everything else separates words. The n-grams (1 to 3)
are hashed into a table whose rows hold the log-probabilities of the languages; the table (under 6 MB, of fixed size)
is broadcast and a batch is scored by gathering rows and summing them over stretches of ``STRETCH`` letters. The
stretches of a text are then labelled together (Viterbi), a change of language costing less between sentences.

Results for odd input: null text, or text without letters, has language null and confidence 0; documents with null
lang count as unlabelled; repeated rows give repeated rows; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from convolens.llm.batches import slices
from convolens.session import table

#: Letters of a stretch, the unit that gets one language.
STRETCH = 32
#: Nats it costs to change the language inside a sentence, and between sentences.
INSIDE, BETWEEN = 40.0, 18.0
#: Buckets (bits) for n-grams of 1, 2 and 3.
BITS = (13, 15, 16)
OFFSETS = (0, 1 << 13, (1 << 13) + (1 << 15))
ROWS = OFFSETS[2] + (1 << 16)
ALPHA = 0.02
#: Labelled sentences used for fitting, at most; and labelled documents of at most so many characters, which are added
#: where a model of the sentences alone agrees with their label.
TRAIN_ROWS, TRAIN_DOCUMENTS, TRAIN_CHARS = 20_000, 3_000, 2_000
#: A language belongs to a text from this share of its letters on.
LEAST_SHARE = 0.1
#: Characters scored at a time; bytes of text labelled at a time.
BLOCK, SLICE = 1 << 19, 12 << 20

#: How the languages of the data are named (ISO 639-1: 639-2 and 639-3 codes, English and own names).
NAMES = {
    "ar": "ar ara arabic العربية", "de": "de deu ger german deutsch", "en": "en eng english", "es": "es spa spanish español espanol castellano castilian",
    "fr": "fr fra fre french français francais", "hi": "hi hin hindi हिन्दी हिंदी", "it": "it ita italian italiano", "ja": "ja jpn japanese 日本語",
    "nl": "nl nld dut dutch nederlands flemish", "pt": "pt por portuguese português portugues", "ru": "ru rus russian русский", "th": "th tha thai ไทย ภาษาไทย", "zh": "zh zho chi cmn chinese mandarin 中文 汉语 漢語",
}
CODES = {name: code for code, names in NAMES.items() for name in names.split()}
_TERMINATORS = ".!?。！？…।؟\n\r"


def declared(label: str | None) -> str | None:
    """ISO 639-1 code that a label names, whatever its writing, region or script; None if it names none."""
    if label is None:
        return None
    x = unicodedata.normalize("NFC", label).strip().lower()
    for part in (x, x.replace("_", "-").split("-")[0].strip(), x.split("(")[0].strip(), x.split(" ")[0]):
        if part in CODES:
            return CODES[part]
    return None


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the folded lower-case letter (0: no letter; marks of Latin letters drop out as 1), and sentence ends."""
    fold = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind[0] == "L":
            base = unicodedata.normalize("NFKD", ch)[0].lower() if c < 0x250 or 0xFF00 <= c < 0xFFF0 or 0x1E00 <= c < 0x2000 else ch.lower()
            fold[c] = ord(base) if len(base) == 1 else c
        elif kind[0] == "M":
            fold[c] = 1 if 0x300 <= c < 0x370 else c
    ends = np.zeros(0x110000, bool)
    ends[[ord(x) for x in _TERMINATORS]] = True
    return fold, ends


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points, a newline after each; and where each begins (and the end of all)."""
    joined = "\n".join(texts) + "\n"
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return cps, starts


def _grams(z: np.ndarray) -> list[np.ndarray]:
    """Bucket numbers of the 1-, 2- and 3-grams that end at each element of z."""
    one = z * np.uint32(0x9E3779B1)
    p = np.empty_like(z)
    p[0], p[1:] = 0, z[:-1]
    two = one ^ (p * np.uint32(0x85EBCA77))
    p2 = np.empty_like(z)
    p2[:2], p2[2:] = 0, z[:-2]
    three = two + p2 * np.uint32(0xC2B2AE3D)
    three ^= three >> np.uint32(15)
    three *= np.uint32(0x2C1B3C6D)
    two = (two ^ (two >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return [(h >> np.uint32(32 - b)).astype(np.int64) + o for h, b, o in zip((one, two, three), BITS, OFFSETS)]


def sep_after(cps: np.ndarray) -> np.ndarray:
    """False where an ASCII letter or digit follows: such a full stop ends nothing."""
    n = cps[1:]
    return ~(((n >= 48) & (n < 58)) | ((n >= 97) & (n < 123)))


class Stretches:
    """Stretches of a batch of texts: text number, first code point in the text, letters, sentence-initial or not, scores."""

    __slots__ = ("text", "start", "letters", "fresh", "scores")

    def __init__(self, text, start, letters, fresh, scores):
        self.text, self.start, self.letters, self.fresh, self.scores = text, start, letters, fresh, scores


def stretches(texts: list[str], matrix: np.ndarray) -> Stretches:
    fold, ends = tables()
    cps, starts = code_points(texts)
    z = fold[cps]
    keep = z != 1
    end = ends[cps]
    end[:-1] &= sep_after(cps)
    # of runs of separators only the first stays
    sep = z == 0
    keep[1:] &= ~(sep[1:] & sep[:-1])
    at = np.flatnonzero(keep)
    sentence = np.cumsum(end)[at]
    z = z[at]
    letter = z != 0
    if not letter.any():
        return Stretches(*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, bool), np.zeros((0, matrix.shape[1]), np.float32))
    text = np.searchsorted(starts, at, "right") - 1
    count = np.cumsum(letter)
    lone = np.flatnonzero(letter)
    s = sentence[lone]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    inside = np.arange(len(lone)) - np.repeat(first, np.diff(np.r_[first, len(lone)]))
    cut = np.flatnonzero(inside % STRETCH == 0)
    heads = lone[cut]  # in z
    idx = _grams(z)
    score = matrix[idx[0]]
    score += matrix[idx[1]]
    score += matrix[idx[2]]
    score[~letter] *= 0.5
    sums = np.add.reduceat(score, heads, axis=0)
    letters = np.diff(np.r_[cut, len(lone)])
    del count
    return Stretches(text[heads], at[heads] - starts[text[heads]], letters, inside[cut] == 0, sums)


def scored(texts: list[str], matrix: np.ndarray) -> Stretches:
    """Stretches of any number of texts of any length, by blocks of bounded size."""
    parts, block, size = [], [], 0

    def flush():
        nonlocal block, size
        if block:
            s = stretches([t for _, _, t in block], matrix)
            num = np.array([n for n, _, _ in block], np.int64)
            off = np.array([o for _, o, _ in block], np.int64)
            parts.append(Stretches(num[s.text], s.start + off[s.text], s.letters, s.fresh, s.scores))
            block, size = [], 0

    for n, t in enumerate(texts):
        for o in range(0, len(t), BLOCK):
            piece = t[o : o + BLOCK]
            if size + len(piece) > BLOCK:
                flush()
            block.append((n, o, piece))
            size += len(piece)
    flush()
    if not parts:
        parts = [stretches([""], matrix)]
    return Stretches(*(np.concatenate([getattr(p, k) for p in parts]) for k in Stretches.__slots__))


def label(s: Stretches, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The language number of each stretch, and its confidence."""
    k = len(s.text)
    if not k:
        return np.zeros(0, np.int64), np.zeros(0)
    own = s.scores.argmax(1)
    begin = np.searchsorted(s.text, np.arange(n))
    size = np.diff(np.r_[begin, k])
    out = own.copy()
    change = np.r_[False, (own[1:] != own[:-1]) & (s.text[1:] == s.text[:-1])]
    mixed = np.unique(s.text[change])
    mixed = mixed[np.argsort(-size[mixed], kind="stable")]
    if len(mixed):
        m = s.scores.shape[1]
        b, length = begin[mixed], size[mixed]
        back = np.zeros((k, m), np.int8)
        same = np.arange(m, dtype=np.int8)
        state = s.scores[b].copy()
        last = np.zeros((len(mixed), m), np.float32)
        last[:] = state
        for t in range(1, int(length[0])):
            d = int(np.searchsorted(-length, -t, "left"))  # texts with more than t stretches
            state = state[:d]
            rows = b[:d] + t
            arg = state.argmax(1)
            other = state[np.arange(d), arg] - np.where(s.fresh[rows], BETWEEN, INSIDE)
            stay = state >= other[:, None]
            back[rows] = np.where(stay, same, arg[:, None].astype(np.int8))
            state = np.where(stay, state, other[:, None]) + s.scores[rows]
            last[:d] = state
        cur = last.argmax(1)
        for t in range(int(length[0]) - 1, -1, -1):
            d = int(np.searchsorted(-length, -t, "left"))
            rows = b[:d] + t
            out[rows] = cur[:d]
            cur[:d] = back[rows, cur[:d]] if t else cur[:d]
    e = s.scores - s.scores.max(1, keepdims=True)
    np.exp(np.maximum(e * 0.25, -60), out=e)
    return out, e[np.arange(k), out] / e.sum(1)


def fit(rows: list[tuple[str, str]]) -> tuple[np.ndarray, list[str]]:
    """Log-probabilities (buckets x languages, centred on their mean) and the languages, from (language, sentence) rows."""
    rows = [(lang, t) for lang, t in rows if lang and t]
    langs = sorted({lang for lang, _ in rows})
    fold, _ = tables()
    counts = np.zeros((ROWS, len(langs)))
    for j, lang in enumerate(langs):
        cps, _ = code_points([t for x, t in rows if x == lang])
        z = fold[cps]
        z = z[z != 1]
        z = z[np.r_[True, (z[1:] != 0) | (z[:-1] != 0)]]
        for h in _grams(z):
            counts[:, j] += np.bincount(h, minlength=ROWS)
    out = np.zeros_like(counts)
    for o, b in zip(OFFSETS, BITS):
        part = counts[o : o + (1 << b)] + ALPHA
        out[o : o + (1 << b)] = np.log(part / part.sum(0))
    out -= out.mean(1, keepdims=True)
    return out.astype(np.float32), langs


def model(spark: SparkSession, sf_dir: str, limit: int = TRAIN_ROWS, documents: int = TRAIN_DOCUMENTS):
    """The broadcast model: of at most ``limit`` labelled sentences, then also of at most ``documents`` labelled documents."""
    rows = table(spark, sf_dir, "langsamples").where("lang is not null and text is not null").orderBy("sample_id").limit(limit).select("lang", "text").collect()
    sentences = [(declared(r.lang) or r.lang, r.text) for r in rows]
    if not sentences:
        return spark.sparkContext.broadcast((np.zeros((ROWS, 1), np.float32), ["und"]))
    matrix, langs = fit(sentences)
    docs = table(spark, sf_dir, "documents").where(f"lang is not null and n_chars between 100 and {TRAIN_CHARS} and kind in ('prose', 'asr')")
    # the sample goes by the ids' hashes, so it is the same however the table is split into files; of a large table the
    # lowest hashes hold enough rows, so that no task sends more than a few
    rows = docs.select("doc_id").count()
    if rows > 2 * documents:
        docs = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < (2 * documents << 40) // rows)
    docs = docs.select("doc_id", "lang", "text").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), "doc_id", "text").limit(documents).select("lang", "text").collect()
    pairs = [(declared(r.lang), r.text) for r in docs]
    pairs = [(lang, t) for lang, t in pairs if lang in langs]
    if pairs:
        letters, *_ = shares([t for _, t in pairs], matrix)
        own = letters[np.arange(len(pairs)), [langs.index(lang) for lang, _ in pairs]]
        agreed = own >= 0.8 * letters.sum(1)
        matrix, langs = fit(sentences + [p for p, ok in zip(pairs, agreed) if ok])
    return spark.sparkContext.broadcast((matrix, langs))


def batches_of(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def shares(texts: list[str], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, Stretches, np.ndarray, np.ndarray]:
    """Letters by text and language, confidence mass by text and language; stretches with their language and confidence."""
    s = scored(texts, matrix)
    lang, conf = label(s, len(texts))
    m = matrix.shape[1]
    key = s.text * m + lang
    letters = np.bincount(key, s.letters, len(texts) * m).reshape(-1, m)
    mass = np.bincount(key, s.letters * conf, len(texts) * m).reshape(-1, m)
    return letters, mass, s, lang, conf


def _documents(broadcast):
    def run(batches):
        matrix, langs = broadcast.value
        for batch in slices(batches, most=SLICE):
            texts = batches_of(batch["text"])
            letters, mass, *_ = shares(texts, matrix)
            total = letters.sum(1)
            rows = []
            for i, (doc, lab) in enumerate(zip(batch["doc_id"].to_pylist(), batch["lang"].to_pylist())):
                if not total[i]:
                    rows.append((doc, None, 0.0, [], len(texts[i]), declared(lab)))
                    continue
                own = [j for j in np.argsort(-letters[i], kind="stable") if letters[i, j] >= LEAST_SHARE * total[i]]
                top = own[0]
                rows.append((doc, langs[top], float(mass[i, top] / total[i]), [langs[j] for j in own], len(texts[i]), declared(lab)))
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.list_(pa.string())), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.string())], ["doc_id", "lang", "confidence", "langs", "n_chars", "declared"])

    return run


def document_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, confidence, langs, n_chars, declared): the main language of each document and all that belong to it."""
    return docs.select("doc_id", "lang", "text").mapInArrow(_documents(model(spark, sf_dir)), "doc_id bigint, lang string, confidence double, langs array<string>, n_chars int, declared string")


def _segments(broadcast):
    def run(batches):
        matrix, langs = broadcast.value
        for batch in slices(batches, most=SLICE):
            texts = batches_of(batch["text"])
            _, _, s, lang, conf = shares(texts, matrix)
            if not len(lang):
                continue
            new = np.flatnonzero(np.r_[True, (s.text[1:] != s.text[:-1]) | (lang[1:] != lang[:-1])])
            owner = s.text[new]
            size = np.array([len(t) for t in texts])
            head = np.r_[True, owner[1:] != owner[:-1]]
            start = np.where(head, 0, s.start[new])
            for i in np.flatnonzero(~head):  # a boundary inside a word moves to the word's start
                t, p = texts[owner[i]], int(start[i])
                while p > 0 and t[p - 1].isalpha() and ord(t[p - 1]) < 0x900:
                    p -= 1
                start[i] = p
            stop = np.r_[start[1:], 0]
            stop = np.where(np.r_[head[1:], True], size[owner], stop)
            letters = np.add.reduceat(s.letters, new)
            mass = np.add.reduceat(s.letters * conf, new)
            doc = batch["doc_id"].take(pa.array(owner))
            no = np.arange(len(new)) - np.repeat(np.flatnonzero(head), np.diff(np.r_[np.flatnonzero(head), len(new)]))
            yield pa.RecordBatch.from_arrays([doc, pa.array(no.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(stop.astype(np.int64)), pa.array([langs[j] for j in lang[new]]), pa.array(mass / letters)], ["doc_id", "segment_no", "start_char", "end_char", "lang", "confidence"])

    return run


def language_segments(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, segment_no, start_char, end_char, lang, confidence): the stretches of one language, covering each text."""
    return docs.select("doc_id", "text").mapInArrow(_segments(model(spark, sf_dir)), "doc_id bigint, segment_no int, start_char bigint, end_char bigint, lang string, confidence double")


def wrong_labels(docs: DataFrame) -> DataFrame:
    """(doc_id, lang) rows of documents (from document_languages) whose label is missing or wrong, or that are mixed."""
    cases = docs.where("n_chars >= 40 and lang is not null and (size(langs) > 1 or declared is null or declared != lang)")
    return cases.selectExpr("doc_id", "explode(langs) as lang")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrong_labels(document_languages(spark, table(spark, sf_dir, "documents"), sf_dir))


def p4_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_languages(spark, table(spark, sf_dir, "documents"), sf_dir)


def p4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_segments(spark, table(spark, sf_dir, "documents"), sf_dir)
