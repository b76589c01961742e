"""JSON out of the answers of language models: found, repaired, parsed and put into form."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

ANNOTATION = T.StructType([T.StructField(n, t) for n, t in (("has_hate_speech", T.BooleanType()), ("has_advertisement", T.BooleanType()), ("target_group", T.StringType()), ("hate_speech_type", T.StringType()), ("main_topic", T.StringType()), ("error", T.StringType()))])
_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S | re.I)


def first_object(text: str) -> str | None:
    """The first {...} whose braces balance outside strings; if it never closes, up to the last }."""
    begin = text.find("{")
    if begin < 0:
        return None
    depth, at = 0, begin
    for m in re.compile(r'"(?:[^"\\]|\\.)*"|[{}]', re.S).finditer(text, begin):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            at = m.end()
            if depth == 0:
                return text[begin:at]
    return text[begin:at] if at > begin else None


class Lenient:
    """Reads one value the way a person would: either quote or none around names, line breaks in strings, commas to spare.

    A scanner with one method for each kind of token; what no reading makes sense of is a ValueError.
    """

    WORDS = {"true": True, "false": False, "null": None, "none": None}
    _blank = re.compile(r"[\s,\x00-\x1f\x7f]*")
    _bare = re.compile(r"[^\s\"'{}\[\],:]+")
    _escapes = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        self.at = self._blank.match(self.text, self.at).end()
        if self.at == len(self.text):
            raise ValueError("text ends inside a value")
        return self.text[self.at]

    def value(self):
        c = self.peek()
        if c == "{":
            return self.members()
        if c == "[":
            return self.items()
        return self.string(c) if c in "\"'" else self.word()

    def members(self) -> dict:
        out = {}
        self.at += 1
        while self.peek() != "}":
            c = self.text[self.at]
            name = self.string(c) if c in "\"'" else self.bare()
            if self.peek() != ":":
                raise ValueError(f"no colon after {name!r}")
            self.at += 1
            out[name] = self.value()
        self.at += 1
        return out

    def items(self) -> list:
        out = []
        self.at += 1
        while self.peek() != "]":
            out.append(self.value())
        self.at += 1
        return out

    def string(self, quote: str) -> str:
        """Up to the quote that a comma, colon, bracket or the end follows, so an apostrophe ends nothing."""
        out, i = [], self.at + 1
        while i < len(self.text):
            c = self.text[i]
            if c == "\\" and i + 1 < len(self.text):
                n = self.text[i + 1]
                if n == "u" and re.fullmatch("[0-9a-fA-F]{4}", self.text[i + 2 : i + 6]):
                    out.append(chr(int(self.text[i + 2 : i + 6], 16)))
                    i += 6
                    continue
                out.append(self._escapes.get(n, n))
                i += 2
                continue
            if c == quote and (quote == '"' or re.match(r"\s*(?:[,:}\]]|\Z)", self.text[i + 1 :])):
                self.at = i + 1
                return "".join(out)
            out.append(c)
            i += 1
        raise ValueError("text ends inside a string")

    def bare(self) -> str:
        m = self._bare.match(self.text, self.at)
        if not m:
            raise ValueError(f"no name or value at {self.at}")
        self.at = m.end()
        return m[0]

    def word(self):
        word = self.bare()
        if word.lower() in self.WORDS:
            return self.WORDS[word.lower()]
        number = float(word)  # or a ValueError
        return int(word) if re.fullmatch(r"-?\d+", word) else number


def parsed(answer: str | None) -> dict:
    """The annotation in an answer; with an error if there is none."""
    empty = dict.fromkeys(ANNOTATION.fieldNames())
    if not answer or not answer.strip():
        return empty | {"error": "empty response"}
    m = _FENCE.search(answer)
    body = first_object(m[1] if m else answer)
    if body is None:
        return empty | {"error": "no JSON object"}
    try:
        data = json.loads(body)
    except ValueError:
        try:
            data = Lenient(body).value()
        except (ValueError, RecursionError):
            data = None
    if not isinstance(data, dict):
        return empty | {"error": "invalid JSON"}
    out = {k: bool(data.get(k)) for k in ("has_hate_speech", "has_advertisement")}
    text = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v)
    out |= {k: text(data.get(k)) for k in ("target_group", "hate_speech_type", "main_topic")}
    if not out["has_hate_speech"]:
        out["target_group"] = out["hate_speech_type"] = None
    return out | {"error": None}


def parse_annotation(answer: Column) -> Column:
    """The answers' annotations as structs (a stateful scan, so an Arrow-batched function)."""

    @F.pandas_udf(ANNOTATION)
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parsed(v) for v in x], columns=ANNOTATION.fieldNames())

    return run(answer)


def problems_of(answer: Column, required: dict[str, str]) -> Column:
    """What is wrong with a JSON answer: 'no JSON', or its fields that lack or aren't of the wanted type, in order; empty if nothing is. JVM only.

    The object is the text between the outermost braces; types are boolean, number, string, array and object.
    """
    kinds = {"boolean": "BOOLEAN", "number": "BIGINT|DOUBLE|DECIMAL|FLOAT|INT", "string": "STRING", "array": "ARRAY", "object": "OBJECT|STRUCT|VOID"}
    v = F.try_parse_json(F.regexp_extract(answer, r"(?s)(\{.*\})", 1))
    faults = []
    for name, kind in required.items():
        field = F.try_variant_get(v, f"$.{name}", "variant")
        given = F.schema_of_variant(field)
        faults.append(F.when(field.isNull() | F.is_variant_null(field), F.lit(f"{name}: missing")).when(~given.rlike(f"^(?:{kinds[kind]})"), F.lit(f"{name}: no {kind}")))
    return F.when(v.isNull(), F.array(F.lit("no JSON"))).otherwise(F.filter(F.array(*faults), lambda x: x.isNotNull()))


def roles_of(answer: Column) -> Column:
    """Roles {name, role} in an answer's outermost braces: HOST, GUEST, else NEITHER. JVM only."""
    body = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    got = F.from_json(body, "classifications array<struct<name:string,role:string>>")["classifications"]
    return F.transform(F.coalesce(got, F.expr("cast(array() as array<struct<name:string,role:string>>)")), lambda r: F.struct(r["name"].alias("name"), F.when(F.upper(r["role"]).isin("HOST", "GUEST"), F.upper(r["role"])).otherwise("NEITHER").alias("role")))
