"""Where outside models plug in: protocols, and deterministic stand-ins to run and test the plans without models.

A model object is sent to the workers once per task and called with batches of texts; blank texts never reach it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from convolens.functions.jsonfix import parse_annotation
from convolens.functions.text import count_words, is_blank

CLASSIFIED = "array<struct<model_name:string,label:string,confidence:double>>"


class Classifier(Protocol):
    name: str

    def classify(self, texts: list[str]) -> list[tuple[str, float]]: ...


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> list[list[float]]: ...


class NameFinder(Protocol):
    """Finds names of people: of each text a list of (name, position, confidence)."""

    def names(self, texts: list[str]) -> list[list[tuple[str, int, float]]]: ...


class Annotator(Protocol):
    def answer(self, texts: list[str]) -> list[str]: ...


def _unit(text: str, salt: str) -> float:
    return int.from_bytes(hashlib.sha256(f"{salt}:{text}".encode()).digest()[:6], "big") / float(1 << 48)


class HashClassifier:
    """Label and confidence from a hash of the text."""

    def __init__(self, name: str, labels: list[str]):
        self.name, self.labels = name, labels

    def classify(self, texts):
        return [(self.labels[int(_unit(t, self.name) * len(self.labels))], round(_unit(t, self.name + "#"), 4)) for t in texts]


class HashEncoder:
    def __init__(self, size: int = 16):
        self.size = size

    def encode(self, texts):
        return [[_unit(t, str(i)) * 2 - 1 for i in range(self.size)] for t in texts]


class HashAnnotator:
    def answer(self, texts):
        return ['{"has_hate_speech": %s, "has_advertisement": false, "main_topic": "topic %d"}' % ("true" if _unit(t, "h") > 0.9 else "false", int(_unit(t, "t") * 9)) for t in texts]


class CapitalNames:
    """Stands in for a recogniser: runs of two or three capitalised words, confidence 0.7."""

    _run = re.compile(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+){1,2}\b")

    def names(self, texts):
        return [[(m[0], m.start(), 0.7) for m in self._run.finditer(t)] for t in texts]


def recognised_names(df: DataFrame, model: NameFinder, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, name, position, confidence, context): names that a recogniser finds, with 50 characters on both sides."""

    @F.pandas_udf("array<struct<name:string,position:int,confidence:double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            got = model.names(["" if t is None else t for t in x])
            yield pd.Series([[{"name": n, "position": p, "confidence": float(c)} for n, p, c in names] for names in got])

    found = df.select(*keys, F.col(text).alias("_text"), run(F.col(text)).alias("_names")).select(*keys, "_text", F.inline("_names"))
    begin = F.greatest(F.col("position") - 50, F.lit(0))
    context = F.col("_text").substr(begin + 1, F.col("position") + F.length("name") + 50 - begin)
    return found.select(*keys, "name", "position", "confidence", context.alias("context"))


@dataclass(frozen=True)
class Task:
    """One question to an annotator: which texts it gets, on what other answers it depends, and which answers count."""

    name: str
    labels: tuple[str, ...] = ()
    depends_on: tuple[str, ...] = ()
    min_words: int = 0
    max_words: int | None = None


def tasks(config: dict) -> list[Task]:
    """The tasks of a configuration {tasks: {name: {labels, depends_on, min_words, max_words}}}, each after those it depends on."""
    made = {n: Task(n, tuple(t.get("labels") or ()), tuple(t.get("depends_on") or ()), int(t.get("min_words") or 0), t.get("max_words")) for n, t in (config.get("tasks") or {}).items()}
    order: list[Task] = []
    while len(order) < len(made):
        done = {t.name for t in order}
        ready = [t for t in made.values() if t.name not in done and set(t.depends_on) <= done]
        if not ready:
            raise ValueError("tasks depend on each other, or on tasks that aren't there")
        order += ready
    return order


def wanted_by(task: Task, text: Column) -> Column:
    """Whether a task takes a text."""
    n = count_words(text)
    return ~is_blank(text) & (n >= task.min_words) & (F.lit(True) if task.max_words is None else n <= task.max_words)


def valid_label(task: Task, label: Column) -> Column:
    """The label as the task writes it, whatever the case; null if the task has no such label. Tasks without labels take any."""
    if not task.labels:
        return label
    out = F.lit(None).cast("string")
    for x in task.labels:
        out = F.when(F.lower(F.trim(label)) == x.lower(), F.lit(x)).otherwise(out)
    return out


def classify(df: DataFrame, models: list[Classifier], text: str = "text", errors: str | None = None) -> DataFrame:
    """Adds classifications: for each model its top label; empty for blank texts. A model that fails is left out.

    With ``errors`` a column of that name says which models failed on a row's batch and how, so that failures can be counted.
    """

    @F.pandas_udf(f"classifications {CLASSIFIED}, errors array<struct<model_name:string,error:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            texts = ["" if t is None else t for t in x]
            at = [i for i, t in enumerate(texts) if t.strip()]
            out: list[list[dict]] = [[] for _ in texts]
            failed: list[dict] = []
            for m in models:
                try:
                    got = m.classify([texts[i] for i in at])
                except Exception as e:  # noqa: BLE001
                    failed.append({"model_name": m.name, "error": type(e).__name__})
                    continue
                for i, (label, conf) in zip(at, got):
                    out[i].append({"model_name": m.name, "label": label, "confidence": float(conf)})
            yield pd.DataFrame({"classifications": out, "errors": [failed] * len(texts)})

    done = df.withColumn("_done", run(F.col(text))).withColumn("classifications", F.col("_done.classifications"))
    return (done if errors is None else done.withColumn(errors, F.col("_done.errors"))).drop("_done")


def embed(df: DataFrame, model: Encoder, text: str = "text") -> DataFrame:
    """Adds embedding, for empty texts too."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(model.encode(["" if t is None else t for t in x]))

    return df.withColumn("embedding", run(F.col(text)))


def annotate(df: DataFrame, model: Annotator, gate: Column, text: str = "text") -> DataFrame:
    """Adds the parsed annotation where the gate holds (null elsewhere); only gated, non-blank texts reach the model."""

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            at = [i for i, t in enumerate(x) if isinstance(t, str)]
            got = dict(zip(at, model.answer([x.iloc[i] for i in at]))) if at else {}
            yield pd.Series([got.get(i) for i in range(len(x))], dtype=object)

    wanted = F.when(gate & ~is_blank(F.col(text)), F.col(text))
    return df.withColumn("_answer", ask(wanted)).withColumn("annotation", F.when(F.col("_answer").isNotNull(), parse_annotation(F.col("_answer")))).drop("_answer")
