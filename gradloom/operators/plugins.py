"""Pluggable models: embedding, language models and document extraction behind small interfaces.

The engine runs them in Arrow batches with one instance for each worker; the defaults are
deterministic and need no model files.
"""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradloom.functions.rewrite import strip
from gradloom.workers import ship


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray: ...


class Llm(Protocol):
    def __call__(self, prompt: str) -> str: ...


def hashing_embedder(dims: int = 384) -> Embedder:
    """Signed feature hashing of words, normalised: stands in for a sentence model."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                out[i, h % dims] += 1 if h >> 31 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)

    return embed


def encode(rows: DataFrame, key: str, text: str, make: Callable[[], Embedder] = hashing_embedder, batch: int = 64) -> DataFrame:
    """``key, embedding`` of every row; ``make`` is called once for each task, and keeps what is costly to load."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                v = model([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(v.astype(np.float32)), pa.list_(pa.float32()))], names=[key, "embedding"])

    ship(rows.sparkSession)
    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, embedding array<float>")


def missing_embeddings(rows: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """The rows that have no cached vector."""
    return rows.join(cache.select(key), key, "left_anti")


def encode_missing(rows: DataFrame, cache: DataFrame, key: str, text: str, make: Callable[[], Embedder] = hashing_embedder, batch: int = 64) -> DataFrame:
    """``key, embedding`` of the rows that ``cache`` hasn't: what an incremental run adds to it."""
    return encode(missing_embeddings(rows, cache, key), key, text, make, batch)


def ask(prompts: DataFrame, key: str, prompt: str, chain: list[tuple[str, Llm]], tries: int = 3, wait: float = 1.0) -> DataFrame:
    """``key, answer, model``: the first model of the chain that answers, with back-off between
    tries; a null answer and ``none`` when all fail."""
    kind = dict(prompts.dtypes)[key]

    def one(text: str) -> tuple[str | None, str]:
        for name, llm in chain:
            for i in range(tries):
                try:
                    if (out := llm(text)) and out.strip():
                        return out, name
                    break
                except Exception:  # a provider's failure is its own kind; the next try or model answers
                    time.sleep(wait * 2**i if i + 1 < tries else 0)
        return None, "none"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            answers = [one(p or "") for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([a for a, _ in answers], pa.string()), pa.array([m for _, m in answers], pa.string())], names=[key, "answer", "model"])

    ship(prompts.sparkSession)
    return prompts.select(key, prompt).mapInArrow(run, f"{key} {kind}, answer string, model string")


def same_verdict(answer: Column) -> tuple[Column, Column]:
    """(same, confidence) of a confirmation reply; a confidence of 1 or less is a share of 100."""
    word = F.upper(F.regexp_extract(answer, r"(?i)same\s*:\s*(yes|no)", 1))
    number = F.nullif(F.regexp_extract(answer, r"(?i)confidence\s*:\s*(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")
    scaled = F.when(number <= 1, number * 100).otherwise(number)
    return F.coalesce(word == "YES", F.lit(False)), F.coalesce(F.least(F.lit(100.0), F.greatest(F.lit(0.0), scaled)), F.lit(0.0)).cast("int")


def similarity_verdict(answer: Column) -> tuple[Column, Column]:
    """(similar, confidence from 0 to 1) of a VERDICT reply."""
    word = F.upper(F.regexp_extract(answer, r"(?i)verdict\s*:\s*(similar|different)", 1))
    number = F.nullif(F.regexp_extract(answer, r"(?i)confidence\s*:\s*(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")
    return word == "SIMILAR", F.coalesce(number / 100, F.lit(0.5))


def cleaned_text_verdict(original: Column, cleaned: Column) -> Column:
    """What is wrong with a model's cleaned text, null if nothing is."""
    rx = F.lit(r"(?m)^\s*(?:Q\.?\s*)?\d+\s*[.)]")
    drift = F.abs(F.regexp_count(original, rx) - F.regexp_count(cleaned, rx))
    share = F.length(cleaned) / F.nullif(F.length(original), F.lit(0))
    return F.when(F.length(strip(F.coalesce(cleaned, F.lit("")))) < 10, "too short").when(drift > 2, "question count mismatch").when((share < 0.5) | (share > 2), "length deviation")
