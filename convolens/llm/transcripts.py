"""Speaker turns of transcript files of several layouts, by parsing-expression grammars.

The layouts' cue headers (times, cue numbers, labels) are tokens of one grammar, and a file may have several layouts; annotations, which nest, are rules of
another. Parse trees become cleaned utterances: sound notes and hesitations go, spoken asides stay. The language of
each cue, needed to tell hesitations from words, comes from the naive Bayes model of langid.

Results for odd input: null, empty and cue-less texts have no turns; a cue before any label has a null speaker; cues
of equal start keep the order of the file; repeated rows give repeated turns; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from convolens.llm import langid
from convolens.llm.batches import slices
from convolens.llm.peg import Grammar, Node
from convolens.session import table

HEADERS = Grammar(r"""
digit    <~ [0-9]
gap      <~ [ \t ]*
clock    <~ digit{1,3} ':' digit{2} (':' digit{2})? ([.,] digit{1,3})?
seconds  <~ digit+ ('.' digit+)?
title    <~ ("dr" / "prof" / "mr" / "mrs" / "ms" / "sr" / "sra" / "dra" / "sig" / "frau" / "herr" / "mme" / "m") '.'? [ ]+
role     <~ gap ('(' [^()\n:0-9]+ ')' / '[' [^\[\]\n:0-9]+ ']')
word     <~ [^\W\d_]+ (['’\-] [^\W\d_]+)*
name     <~ word ([ _ ]+ word){0,3}
channel  <~ ("speaker" / "spk" / "s") [ _\-]* digit{1,4}
label    <~ (channel ![^\W\d_] / name) role?
labelled <~ gap title? label gap

brackets <~ ^ gap '[' at:clock ']' gap (who:labelled ':' ' ')?
span     <~ ^ gap '[' from:seconds 's - ' seconds 's]' gap (who:labelled ':' ' ')?
trailing <~ ^ gap (who:labelled gap)? '(' at:clock '):'
leading  <~ ^ gap at:clock ' ' (who:labelled)? '- '
block    <~ ^ (who:labelled) gap at:clock gap $
arrow    <~ ^ gap at:clock gap '-->' gap clock [^\n]* $
srt      <~ gap (who:labelled ':' ' ')?
voice    <~ gap '<v' [^ \n>]* gap who:([^>\n]*) '>'
number   <~ ^ gap digit+ gap $
""")

#: Words of sound notes (those in the data's languages, and their usual variants).
SOUNDS = """
laughter laughs laughing laugh coughs coughing cough applause clapping claps door slams music playing plays crosstalk inaudible noise sighs sigh silence
cheering cheers background indistinct unintelligible chuckles crying whispers sneezes phone ringing rings static pause beep
lachen lacht gelächter musik applaus hustet husten seufzt seufzen unverständlich rauschen stille geräusch tür knallt beifall klatschen räuspert
rires rire musique soupir soupire applaudissements inaudible toux tousse bruit silence porte claque brouhaha
risas risa ríe música aplausos tose tos suspira suspiro inaudible ruido silencio puerta ininteligible
risos riso ri música aplausos tosse tossir suspira suspiro inaudível ruído silêncio porta palmas ininteligível
risate ride musica applausi tossisce sospira incomprensibile rumore gelach lacht muziek applaus hoest zucht onverstaanbaar geluid stilte
смех музыка аплодисменты кашель вздох вздыхает неразборчиво шум тишина
""".split()

ANNOTATIONS = Grammar(r"""
sounding <~ ("SOUNDS") ![^\W_]
time     <~ [0-9]{1,3} (':' [0-9]{2}){1,2} ([.,] [0-9]+)?
space    <~ [\s.,;:…!\-–]+
other    <~ [^()\[\]<>*♪{}]
sound    <- space? (sounding / note) (space / sounding / time / note)*
note     <- '[' (sound / space) ']' / '(' sound ')' / '<' sound '>' / '*' sound '*' / '{' sound '}' / music
music    <~ '♪'+ ([ ]* '♪')*
aside    <- '(' (note / aside / other)* ')' / '[' (note / aside / other)* ']'
mark     <- note / aside
""".replace('("SOUNDS")', "(" + " / ".join(f'"{w}"' for w in sorted(dict.fromkeys(SOUNDS), key=lambda w: (-len(w), w))) + ")"))  # fmt: skip

#: Hesitation sounds by language; each letter may be drawn out.
HESITATIONS = {
    "en": "u+m+|u+h+|u+h+m+|e+r+|e+r+m+|h+m{2,}|m{2,}|a+h+m+|e+h+m+",
    "de": "ä+h+|ä+h+m+|ö+h+|ö+h+m+|h+m+|m{2,}|e+h+m+",
    "fr": "e+u+h+|h+e+u+|h+u+m+|h+m+|m{2,}",
    "es": "e+h+|e+m+|e+h+m+|m{2,}|h+m+",
    "pt": "a+h+ã+|h+ã+|é{2,}|h+u+m{2,}|h+m+|m{2,}",
    "it": "e+h+m+|u+h+m*|m{2,}|h+m+|e+h{2,}",
    "nl": "u+h+m*|e+h+m*|h+m+|m{2,}",
    "ru": "э{2,}|э+м+|м{2,}|х+м+|гм+|э-э+",
}
_ANY = re.compile(r"(?<![\w'’\-])(?:" + "|".join(dict.fromkeys("|".join(HESITATIONS.values()).split("|"))) + r")(?![\w'’]|-\w)", re.I)
_HES = {k: re.compile(rf"(?<![\w'’\-])(?:{v})(?![\w'’]|-\w)", re.I) for k, v in HESITATIONS.items()}
_OPEN = re.compile(r"[\[(<*{♪]")
_TOKEN = re.compile(r"\S*[^\W_]\S*")
_NUMBER = re.compile(r"^(?:speaker|spk|s)[ _\-]*0*(\d+)$", re.I)
_ROLE = re.compile(r"[\[(][^\])]*[\])]")
_TITLE = re.compile(r"^(?:dr|prof|mr|mrs|ms|sr|sra|dra|sig|frau|herr|mme|m)(?:\.\s*|\s+)", re.I)


def speaker_of(label: str) -> str | None:
    """SPEAKER_nn for a numbered label, else the name in lower case without title and role; None if nothing is left."""
    x = " ".join(_ROLE.sub(" ", label).replace("_", " ").replace(" ", " ").split())
    if m := _NUMBER.match(x):
        return f"SPEAKER_{int(m[1]):02d}"
    y = _TITLE.sub("", x)
    return " ".join((y if y else x).lower().split()) or None


def _even(label: str) -> bool:
    """A numbered label, or a name of two or three words all written alike; so no words of a sentence before a colon."""
    x = _ROLE.sub(" ", label).strip()
    if _NUMBER.match(x.replace(" ", " ")):
        return True
    words = _TITLE.sub("", x).replace("_", " ").split()
    return 2 <= len(words) <= 3 and (all(w.isupper() for w in words) or all(w.islower() for w in words) or all(w[:1].isupper() and w[1:].islower() for w in words))


def clock_ms(clock: str) -> int:
    parts = clock.replace(",", ".").split(":")
    whole, _, frac = parts[-1].partition(".")
    s = 0
    for p in [*parts[:-1], whole]:
        s = s * 60 + int(p)
    return s * 1000 + int((frac + "000")[:3])


class Cue:
    __slots__ = ("start", "label", "body")

    def __init__(self, start, label, body):
        self.start, self.label, self.body = start, label, body


#: Layouts whose headers have a label in any case.
_NAMED = ("trailing", "leading", "block")
_BY_START = {"[": ("span", "brackets")} | {d: ("arrow", "leading") for d in "0123456789"}


def header(line: str) -> tuple[str, re.Match] | None:
    """The layout that the line is a header of, and the match; no line is a header of two."""
    first = line.lstrip()[:1]
    if not first:
        return None
    # most lines are told by their first and last characters
    names = _BY_START.get(first) or (("trailing",) if "):" in line else ()) + (("block",) if line.rstrip()[-1] in "0123456789" else ())
    for name in names:
        if m := HEADERS.token(name).match(line):
            return name, m
    return None


def _before_arrow(body: list[str]) -> list[str]:
    """Lines without what introduces the cue after them: its number, and the first line of a file."""
    number = HEADERS.token("number").match
    body = list(body)
    for introduces in (number, lambda x: x.startswith("WEBVTT")):
        while body and not body[-1].strip():
            body.pop()
        if body and introduces(body[-1]):
            body.pop()
    return body


def cues(text: str) -> list[Cue]:
    """The cues of a file in its order, whichever layouts it has and wherever they begin. The label is None where a cue has none."""
    lines = [x.removeprefix("\ufeff") for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    found: list[tuple[str, int, int, int, str | None]] = []  # layout, line, column where the body begins, start, label
    for i, line in enumerate(lines):
        hit = header(line)
        if hit is None:
            continue
        kind, m = hit
        start = round(float(m["from"]) * 1000) if kind == "span" else clock_ms(m["at"])
        if kind == "arrow":
            found.append((kind, i, -1, start, None))
        else:
            found.append((kind, i, m.end(), start, m["who"]))
    out = []
    raw = []
    for k, (kind, i, col, start, who) in enumerate(found):
        end = found[k + 1][1] if k + 1 < len(found) else len(lines)
        body = lines[i + 1 : end]
        if k + 1 < len(found) and found[k + 1][0] == "arrow":
            body = _before_arrow(body)
        named = kind in _NAMED
        if col < 0:
            while body and not body[-1].strip():
                body.pop()
            rest = "\n".join(body)
            if m := HEADERS.token("voice").match(rest):
                who, rest = m["who"], rest[m.end() :].replace("</v>", " ")
            elif m := HEADERS.token("srt").match(rest):
                who, rest = m["who"], rest
                raw.append((named, start, who, rest, m.end()))
                continue
            raw.append((named, start, who, rest, 0))
        else:
            raw.append((named, start, who, "\n".join([lines[i], *body]), col))
    sure = {speaker_of(w) for named, _, w, _, _ in raw if w and (named or _even(w))}
    for named, start, who, rest, col in raw:
        if who is not None and not named and col and not _even(who) and speaker_of(who) not in sure:
            col = rest.index(who) if who in rest else 0  # words of the text before a colon
            who = None
        out.append(Cue(start, who, rest[col:]))
    return out


def _kept(node: Node, text: str) -> str:
    """What stays of an annotation's parse tree: asides without their notes."""
    if node.rule in ("mark",):
        return _kept(node.children[0], text)
    if node.rule != "aside":
        return " "
    out, at = [], node.start
    for child in node.children:
        if child.rule in ("note", "aside"):
            out.append(text[at : child.start])
            out.append(_kept(child, text))
            at = child.end
    out.append(text[at : node.end])
    return "".join(out)


#: Brackets with none inside, which parse by themselves; most are, and the same ones come again and again.
_SINGLE = re.compile(r"\[[^()\[\]<>*♪{}]{0,60}\]|\([^()\[\]<>*♪{}]{0,60}\)")


@lru_cache(1 << 16)
def _single(bracket: str) -> str | None:
    """What stays of a bracket without others inside; None if it is no annotation."""
    tree = ANNOTATIONS.match("mark", bracket, 0)
    return _kept(tree, bracket) if tree else None


def without_notes(text: str) -> str:
    """The text without sound notes; each annotation is parsed where its bracket opens."""
    m = _OPEN.search(text)
    if not m:
        return text
    out, at = [], 0
    while m:
        p = m.start()
        single = _SINGLE.match(text, p)
        if single:
            kept = _single(single[0])
            if kept is not None:
                out.append(text[at:p])
                out.append(kept)
                at = single.end()
            m = _OPEN.search(text, max(p + 1, at))
            continue
        tree = ANNOTATIONS.match("mark", text, p) if p >= at else None
        if tree:
            out.append(text[at:p])
            out.append(_kept(tree, text))
            at = tree.end
        m = _OPEN.search(text, max(p + 1, at))
    out.append(text[at:])
    return "".join(out)


@lru_cache(64)
def _set_off(words: tuple[str, ...]) -> re.Pattern:
    return re.compile(r",\s*(?:" + "|".join(r"\s+".join(map(re.escape, w.split())) for w in words) + r")(?=\s*,)", re.I)


def spoken(text: str, lang: str, fillers: dict[str, tuple[str, ...]]) -> str:
    """The text (without notes) less the language's hesitations and the fillers that commas set off."""
    if _ANY.search(text):
        rest = _ANY.sub(" ", text)
        text = rest if not _TOKEN.search(rest) else _HES[lang].sub(" ", text) if lang in _HES else text
    words = fillers.get(lang)
    if words and "," in text:
        text = _set_off(words).sub(",", text)
    return text


_ASIDE = re.compile(r",\s*(?:you\s+know|i\s+mean|sozusagen|weißt\s+du|tu\s+vois|quoi|este|o\s+sea|tipo|sabe)(?=\s*,)", re.I)


def interruptions_removed(text: str) -> str:
    """A transcript's text without notes, hesitations of any language and fillers; for matching phrases only."""
    text = _ANY.sub(" ", without_notes(text))
    return _ASIDE.sub(",", text) if "," in text else text


_TIDY = [(re.compile(r"\s+"), " "), (re.compile(r"(?:[,—–]|\.\.\.|…)(?:\s*(?:[,—–]|\.\.\.|…))+"), ","), (re.compile(r"\s+([,.;:!?…])"), r"\1"), (re.compile(r"^[\s,—–…]+|[\s,—–]+$"), "")]


def tidy(text: str) -> str:
    """One line without the punctuation that removed words leave behind."""
    for pattern, by in _TIDY:
        text = pattern.sub(by, text)
    return text


def document_turns(texts: list[str], matrix: np.ndarray, langs: list[str], fillers: dict[str, tuple[str, ...]]) -> list[list[tuple]]:
    """Of each text its turns (speaker, start_ms, n_words, n_cues, text)."""
    every, owner, plain = [], [], []
    for i, t in enumerate(texts):
        if not t:
            continue
        if not t.isascii():
            t = unicodedata.normalize("NFC", t)
        seen = set()
        for c in sorted(cues(t), key=lambda c: c.start):
            key = (c.start, c.label, c.body.strip())
            if key in seen:
                continue
            seen.add(key)
            every.append(c)
            owner.append(i)
            plain.append(without_notes(c.body))
    out: list[list[tuple]] = [[] for _ in texts]
    if not every:
        return out
    # the language of each cue: the best of those that have a tenth of the document's letters
    s = langid.scored(plain, matrix)
    m = len(langs)
    score = np.zeros((len(plain), m), np.float64)
    np.add.at(score, s.text, s.scores)
    letters = np.bincount(s.text, s.letters, len(plain))
    own = np.array(owner)
    docs = np.zeros((len(texts), m))
    np.add.at(docs, (own, score.argmax(1)), letters)
    allowed = docs >= np.maximum(0.1 * docs.sum(1, keepdims=True), 1e-9)
    chosen = np.where(allowed[own], score, -1e30).argmax(1)
    for c, i, text, j in zip(every, owner, plain, chosen):
        text = spoken(text, langs[j], fillers)
        n = len(_TOKEN.findall(text))
        if not n:
            continue
        turns = out[i]
        who = speaker_of(c.label) if c.label else (turns[-1][0] if turns else None)
        if turns and turns[-1][0] == who:
            turns[-1][2] += n
            turns[-1][3] += 1
            turns[-1][4].append(text)
        else:
            turns.append([who, c.start, n, 1, [text]])
    return out


def _run(broadcast, fillers: dict[str, tuple[str, ...]], with_text: bool):
    def run(batches):
        matrix, langs = broadcast.value
        for batch in slices(batches):
            ids, texts = batch["doc_id"].to_pylist(), langid.batches_of(batch["text"])
            for a in range(0, len(ids), 256):
                rows = []
                for doc, turns in zip(ids[a : a + 256], document_turns(texts[a : a + 256], matrix, langs, fillers)):
                    for no, (who, start, n, k, parts) in enumerate(turns, 1):
                        rows.append((doc, no, who, start, n) + ((k, tidy(" ".join(parts))) if with_text else ()))
                cols = list(zip(*rows)) or [[]] * (7 if with_text else 5)
                kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
                names = ["doc_id", "turn_no", "speaker", "start_ms", "n_words", "n_cues", "text"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names[: len(cols)])

    return run


def exploratory_fillers(lexicon: DataFrame) -> dict[str, tuple[str, ...]]:
    """By language, the exploratory filler keywords (the lexicon is a fixed dimension of under a hundred rows)."""
    out: dict[str, tuple[str, ...]] = {}
    for r in lexicon.where("category = 'filler' and tier = 'exploratory' and keyword is not null and lang is not null").orderBy("ord").select("lang", "keyword").collect():
        out[r.lang] = out.get(r.lang, ()) + (r.keyword.strip().lower(),)
    return out


def turns(spark: SparkSession, docs: DataFrame, sf_dir: str, with_text: bool = True) -> DataFrame:
    """(doc_id, turn_no, speaker, start_ms, n_words[, n_cues, text]) of documents of kind transcript."""
    lines = docs.where("kind = 'transcript' and text is not null").select("doc_id", "text")
    schema = "doc_id bigint, turn_no int, speaker string, start_ms bigint, n_words bigint" + (", n_cues int, text string" if with_text else "")
    return lines.mapInArrow(_run(langid.model(spark, sf_dir), exploratory_fillers(table(spark, sf_dir, "lexicon")), with_text), schema)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, table(spark, sf_dir, "documents"), sf_dir, with_text=False)


def p1_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, table(spark, sf_dir, "documents"), sf_dir)
