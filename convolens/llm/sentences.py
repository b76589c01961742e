"""Sentence units of texts in many languages and scripts, by cascading tables of break and no-break rules.

A text is cut into blocks first (blank lines, headings and list lines; a hard wrap cuts nothing). In a block every
possible end is a position; the tables of the text's languages and the tables common to all are gone through in order,
and the first rule whose two patterns match before and after the position decides. Positions inside a quotation or
bracket that closes in its block are never ends.

Results for odd input: null, empty and blank texts have no sentences; no sentence begins or ends with white space or a
byte-order mark; repeated rows give repeated sentences; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from convolens.llm import langid
from convolens.llm.batches import slices
from convolens.session import table

# Abbreviations by language. HOLD: never the end of a sentence; NUMBER: not before a number; the others
# (etc., p.m., usw.) need no rule, as they end a sentence just when a capital or caseless letter follows.
HOLD = {
    "en": "Dr Prof Mr Mrs Ms St Mt Rev Hon Gen Col Capt Lt Sgt Sen Rep Gov vs e.g i.e cf viz approx al Fig Jr. Dept Sec Adm Maj Cmdr Supt Insp Amb Messrs Ft esp",
    "de": "Dr Prof Hr Fr St Str bzw ca z.B z. d.h d. u.a vgl sog Mio Mrd Tel geb gest evtl ggf inkl exkl Abs Art Abb Kap Ing Dipl Fa Hrsg Inh bspw zzgl abzgl lt",
    "fr": "M MM Dr Pr Prof Me St Ste p. p.ex c.-à-d cf env av bd boul tél fig art Mlle Mmes Mgr Sté",
    "es": "Sr Sra Srta Sres Dr Dra Prof Profa Ing Lic Arq Gral Excmo Ilmo Sto Sta D Dña Ud Uds Av Avda C p. p.ej núm pág tel cap fig art",
    "pt": "Sr Sra Srta Dr Dra Prof Profa Av R D p. p.ex núm pág tel cap fig art Exmo Eng Arq Srs",
    "it": "Sig sig Sig.ra sig.ra Dott dott Dott.ssa dott.ssa Prof prof Ing ing Avv avv Dr p.es ecc. pag art fig v S Egr Spett Gent Arch Geom Rag On",
    "nl": "Dhr dhr Mevr mevr Dr dr Prof prof Mr mr Ir ir Ing ing bijv d.w.z o.a m.n nl ca vgl mln mld St str blz Drs drs jl resp evt incl excl",
    "ru": "г гг ул д кв корп стр им тов проф Проф акад д-р св руб коп млн млрд тыс т рис гл см ср напр доц Доц Г ш пл пр просп обл",
    "hi": "डॉ डा प्रो श्री सु स्व पं",
    "ar": "د أ م ص.ب ش ج",
    "th": "ดร ผศ รศ ศ พ.ศ ค.ศ นพ พญ จ อ ต ถ ซ น",
    "ja": "Dr Mr", "zh": "Dr Mr",
}
NUMBER = {
    "en": "No Nos no p pp Vol vol Ch ch Sec Art Fig fig Nr", "de": "Nr S Bd Kap Abb Abs Art Nrn Ziff", "fr": "n no nº p pp vol chap art fig",
    "es": "n nº núm p pág vol cap art", "pt": "n nº núm p pág vol cap art", "it": "n nr p pp pag vol cap art", "nl": "nr p blz art hfdst", "ru": "№ с стр д кв гл п рис",
}
#: Months after which a day's full stop ends nothing, where ordinals are written with one.
MONTHS = {"de": "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember Jahrhundert".split()}
#: Names end with these, so a capital after one begins a sentence just if it is one of the words that begin one.
ENDINGS = {"en": "Inc Ltd Co Corp Bros LLC Assn Ph.D M.D B.A M.A B.Sc M.Sc"}
BEGINNERS = {"en": "The A An He She It They We I You In On At But And Or So This That These Those There When If As After Before While His Her Its Their Our My Your However What Why How Who Where Then Now No Yes Not One Some Many Most All Both Each For From With Without By To Of Nobody Everyone Please Thanks Also"}
#: states' short names, and what belongs to them when it follows.
STATES = {"en": "U.S U.K U.N E.U"}
OFFICES = {"en": "Senate Senator House Congress Congressman Congresswoman Army Navy Air Marine Marines Coast Postal President Treasury Supreme Department Government Secretary Attorney Ambassador Embassy Open Dollar Constitution Capitol Representative Representatives District Court State Customs Census Steel Geological Parliament Security General Charter"}
#: Thai words that count what the number before them numbers.
CLASSIFIERS = "ตัว คน ล้าน บาท แผ่น ใบ ชั่วโมง ครั้ง เปอร์เซ็นต์ นาที วินาที เล่ม คัน หลัง เรื่อง ตอน ฉบับ ข้อ ชิ้น วัน เดือน กิโล เมตร พัน หมื่น แสน ร้อย สิบ โมง น. ราย แห่ง ครอบครัว ปี รายการ ที่นั่ง ชุด เครื่อง ดวง องศา สาย".split()

#: Characters before a position that rules see; none depends on more (runs of marks look the same).
BACK = 24
ENDS = ".!?…。！？।؟｡．"
CLOSERS = "\"'”’»)\\]」』）›“‟"
_CANDIDATE = regex.compile(rf"[{ENDS}]+(?:\s?»|[{CLOSERS}])*|(?<=\p{{Thai}}|\d|[”\"])[\s]+(?=\S)")


class Rule:
    """Patterns that must match right before and right after a position, and whether it then is an end."""

    __slots__ = ("before", "after", "breaks")

    def __init__(self, before: str | None, after: str | None, breaks: bool):
        self.before = regex.compile(rf"(?:{before})\Z") if before else None
        self.after = regex.compile(after) if after else None
        self.breaks = breaks


def _abbreviations(words: str) -> str:
    return "|".join(sorted((regex.escape(w.rstrip(".")) for w in words.split()), key=len, reverse=True))


#: Rules that hold before any language's: what a mark is part of.
_MARKS = r"[.!?…।؟]+(?:\s?»|[\"'”’»)\]›“])*"
FIRST = [
    Rule(_MARKS, r"\s*[,;:，；：、)\]]", False),  # the sentence goes on after a mark
    Rule(r"[\"”’»“]", r"\s*[—–-]\s", False),  # «…!» — said
    Rule(r"\p{Ll}{3,}\.", r"\p{Lu}\p{Ll}+\s", True),  # the space after the mark is missing
    Rule(r"\.", r"[\p{L}\p{N}º°ª/@_%&=#\-]", False),  # inside numbers, addresses, dotted words
    Rule(_MARKS, r"\s*\p{Ll}", False),  # a small letter follows
    Rule(r"(?<![\p{L}\p{N}.])\p{Lu}\.", r"\s+\p{Lu}", False),  # initials
    Rule(r"(?<![\p{L}\p{N}.])\p{Lu}\.\s?\p{Lu}\.", r"\s+\p{Ll}", False),
    Rule(r"(?:\.\.+|…)", r"\s+[\p{Arabic}\p{Devanagari}]", False),  # no capitals tell: a pause
]
#: Rules for white space in scripts without sentence marks.
SPACES = [
    Rule(r"\p{Thai}", r"\s+[\d“\"(฿$€]", False),
    Rule(r"ปี\s?\d{4}", r"\s+\S", True),
    Rule(r"\d", r"\s+(?:" + "|".join(map(regex.escape, CLASSIFIERS)) + ")", False),
    Rule(r"[”\"]", r"\s+\S", False),
    Rule(r"\p{Thai}|(?<=\p{Thai}\s?[\d.,:]{1,12})\d", r"\s", True),
]
#: What holds for a mark no other rule speaks of.
LAST = [
    Rule(rf"[{ENDS}]+(?:\s?»|[{CLOSERS}])*", None, True),
]


@lru_cache(256)
def cascade(langs: tuple[str, ...]) -> list[Rule]:
    """The rules for a text of these languages, in order."""
    rules = list(FIRST)
    for lang in langs:
        if lang in MONTHS:
            rules.append(Rule(r"(?<![\p{L}\p{N}.,])\d{1,3}\.", r"\s+(?:" + "|".join(MONTHS[lang]) + r")\b", False))
        if lang in HOLD:
            rules.append(Rule(rf"(?<![\p{{L}}\p{{N}}\p{{M}}])(?:{_abbreviations(HOLD[lang])})\.", r"\s", False))
        if lang in ENDINGS:
            name = rf"(?<![\p{{L}}\p{{N}}])(?:{_abbreviations(ENDINGS[lang])})\."
            rules.append(Rule(name, rf"\s+(?:{_abbreviations(BEGINNERS[lang])})\b", True))
            rules.append(Rule(name, r"\s+\p{Lu}", False))
            rules.append(Rule(r"[!?]", rf"\s+(?:{_abbreviations(ENDINGS[lang])})\.", False))  # a name that has a mark
            rules.append(Rule(rf"(?<![\p{{L}}\p{{N}}])(?:{_abbreviations(STATES[lang])})\.", rf"\s+(?:{_abbreviations(OFFICES[lang])})\b", False))
        if lang in NUMBER:
            rules.append(Rule(rf"(?<![\p{{L}}\p{{N}}])(?:{_abbreviations(NUMBER[lang])})\.", r"\s*\d", False))
    return rules + LAST


#: "т. д.", "т. п.": "and so on", which ends a sentence if a capital follows; "т. е.", "т. к." never do.
_SO_ON = regex.compile(r"(?<![\p{L}\p{N}])(?:т\.\s?[дп]|др|пр)\.\Z")

_OPEN = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "‘": "’", "(": ")", "（": "）", '"': '"', "[": "]", "‹": "›"}
_QUOTES = regex.compile(r"[“”„«»「」『』‘’()（）\"\[\]‹›]")


def enclosed(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Outermost quotations and brackets of a block, as (opening mark, position after the closing mark)."""
    marks = [(m.start(), m[0]) for m in _QUOTES.finditer(text, a, b)]
    # the closing mark of each opening one: those of a kind nest, so each kind has a stack
    closes: dict[int, int] = {}
    for opening in {c for _, c in marks if c in _OPEN}:
        closing, waiting = _OPEN[opening], []
        for k, (p, c) in enumerate(marks):
            if c in closing and not (c == "’" and p + 1 < b and text[p + 1].isalpha() and text[p - 1].isalpha()):  # no apostrophe
                if waiting:
                    closes[waiting.pop()] = k
            if c == opening:
                if c in closing:
                    waiting.clear()  # marks that open and close alike don't nest
                waiting.append(k)
    out, i = [], 0
    while i < len(marks):
        at, ch = marks[i]
        k = closes.get(i)
        if k is None or (ch == "‘" and at > a and text[at - 1].isalnum()):
            i += 1
            continue
        out.append((at, marks[k][0] + 1))
        i = k + 1
    return out


_LINE = regex.compile(r"[^\r\n]*(?:\r\n|\r|\n|\Z)")
_MARKED = regex.compile(r"[\s﻿]*(?:#{1,6}|[-*•‣▪◦·+]|[\p{So}\p{Sk}]️?|\d{1,2}[.)]|[a-z]\))[ \t ]+\S")
_ENDED = regex.compile(rf"[{ENDS}:](?:\s?»|[{CLOSERS}])*[\s﻿]*\Z")
_SPACE = " \t\r\n ﻿　  ​  \x0b\x0c\x85"
_CASED = regex.compile(r"\p{Ll}|\p{Lu}")
#: A line of more characters, or of more than six words, is text and no heading unless it is marked as one: a parameter, for
#: scripts without spaces. Values from 24 to 200 give the same sentences in all prose of the test data of scale 0.1.
HEADING = 48


def blocks(text: str) -> list[tuple[int, int]]:
    """Ranges that sentences don't cross: paragraphs, headings and list lines."""
    lines = [(m.start(), m.end()) for m in _LINE.finditer(text) if m.end() > m.start()]
    out: list[tuple[int, int]] = []
    begin: int | None = None
    ended = True  # the line before is blank, a heading, or ends a sentence
    for i, (a, b) in enumerate(lines):
        line = text[a:b].strip(_SPACE)
        if not line:
            if begin is not None:
                out.append((begin, a))
                begin = None
            ended = True
            continue
        marked = _MARKED.match(text, a, b)
        alone = marked
        if not marked and ended and len(line) <= HEADING and b < len(text) and not _ENDED.search(line):
            nxt = text[lines[i + 1][0] : lines[i + 1][1]].strip(_SPACE) if i + 1 < len(lines) else ""
            first = nxt[:1]
            words = len(line.split())
            alone = bool(nxt) and not first.islower() and words <= 6 and line[-1] not in ",;，、،" and not (line[0] in "“\"«„‘「(" or line[0].islower()) and (len(nxt) > len(line) or len(nxt) > 12)
            if alone and any("฀" <= ch < "຀" for ch in line) and " " in line:
                alone = False  # sentences of a script without marks
        if alone:
            if begin is not None:
                out.append((begin, a))
                begin = None
            out.append((a, b))
            ended = True
            continue
        if begin is None:
            begin = a
        ended = bool(_ENDED.search(line)) or "฀" <= line[-1] < "຀"
    if begin is not None:
        out.append((begin, len(text)))
    return out


def _ends(text: str, a: int, b: int, rules: list[Rule]) -> list[int]:
    """Positions of a block at which a sentence ends."""
    spans = enclosed(text, a, b)
    heads = [s for s, _ in spans]
    out: list[int] = []
    last = a
    k = 0
    for m in _CANDIDATE.finditer(text, a, b):
        space = m[0][0] in _SPACE
        p = m.start() if space else m.end()
        while k < len(spans) and spans[k][1] < p:
            k += 1
        if not space and text[p - 1] == "“" and not any(e == p for _, e in spans[max(0, k - 1) : k + 1]):
            p -= 1  # it opens the next sentence
        if k < len(spans) and spans[k][0] < p < spans[k][1]:
            continue
        if p <= last or p >= b:
            continue
        # a quotation that ends here: one that began the sentence goes on unless a capital follows; after one that a
        # colon or verb leads in, the sentence is over
        if k < len(spans) and spans[k][1] == p and text[heads[k]] not in "(（[":
            rest = text[p:b].lstrip(_SPACE)
            opened = not text[last : heads[k]].strip(_SPACE)
            if rest and not _CASED.match(rest) and rest[0].isalpha():
                if opened or rest[0] in "とって":
                    continue
        before = text[max(last, p - BACK) : p]
        if _SO_ON.search(before):
            if not regex.match(r"\s*\p{Ll}|\s*[,;:)]", text[p:b]):
                out.append(p)
                last = p
            continue
        for rule in SPACES if space else rules:
            if (rule.before is None or rule.before.search(before)) and (rule.after is None or rule.after.match(text, p, b)):
                if rule.breaks:
                    out.append(p)
                    last = p
                break
    return out


def split(text: str, langs: tuple[str, ...]) -> list[tuple[int, int]]:
    """(start, end) of each sentence unit of a text in these languages."""
    rules = cascade(langs)
    out = []
    for a, b in blocks(text):
        cuts = [a, *_ends(text, a, b, rules), b]
        for s, e in zip(cuts, cuts[1:]):
            while s < e and text[s] in _SPACE:
                s += 1
            while e > s and text[e - 1] in _SPACE:
                e -= 1
            if e > s:
                out.append((s, e))
    return out


def _run(broadcast, with_text: bool):
    def run(batches):
        matrix, langs = broadcast.value
        for batch in slices(batches):
            texts = langid.batches_of(batch["text"])
            ids = batch["doc_id"].to_pylist()
            for a in range(0, len(texts), 512):
                part = texts[a : a + 512]
                letters, *_ = langid.shares(part, matrix)
                total = letters.sum(1, keepdims=True)
                doc, start, end, words = [], [], [], []
                for i, t in enumerate(part):
                    own = tuple(langs[j] for j in np.argsort(-letters[i], kind="stable") if letters[i, j] > 0.03 * total[i, 0])
                    for s, e in split(t, own):
                        doc.append(ids[a + i])
                        start.append(s)
                        end.append(e)
                        if with_text:
                            words.append(t[s:e])
                cols = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(words, pa.string())] if with_text else []), ["doc_id", "start_char", "end_char", "sentence"][: 4 if with_text else 3])

    return run


def sentences(spark: SparkSession, docs: DataFrame, sf_dir: str, with_text: bool = False) -> DataFrame:
    """(doc_id, start_char, end_char[, sentence]) of each text."""
    schema = "doc_id bigint, start_char bigint, end_char bigint" + (", sentence string" if with_text else "")
    return docs.where("text is not null").select("doc_id", "text").mapInArrow(_run(langid.model(spark, sf_dir), with_text), schema)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(spark, table(spark, sf_dir, "documents").where("kind = 'prose'"), sf_dir)


def p9_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence units of every document."""
    return sentences(spark, table(spark, sf_dir, "documents"), sf_dir, with_text=True)


def p9_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_chars): characters of each document's sentences without white space; they are all the text has."""
    s = sentences(spark, table(spark, sf_dir, "documents"), sf_dir, with_text=True)
    return s.groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("sentence", r"[\s\p{Z}\x0B\x85\uFEFF\u200B]", ""))).cast("bigint").alias("n_chars"))
