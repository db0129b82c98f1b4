"""Encoder and language model as callables of the caller, in Arrow batches; nothing here knows a network or a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.chunking import count_tokens
from tessella.operators.qa import answer_faults

Encoder = Callable[[list[str]], np.ndarray]
Generator = Callable[[str], str]
ENCODER_LIMIT, BATCH = 512, 16


def with_prefix(c: Column, prefix: str) -> Column:
    """The text with the encoder's prefix, unless it has it."""
    return F.when(c.startswith(prefix), c).otherwise(F.concat(F.lit(prefix), c))


def encode(df: DataFrame, column: str, encoder: Encoder, prefix: str = "passage: ", limit: int = ENCODER_LIMIT, batch: int = BATCH, count: Callable[[str], int] = count_tokens) -> DataFrame:
    """`df` with `vector` (float array of length 1) and `vector_fault`. A text above the limit is never cut: it gets the fault too_long and no
    vector; null text gets null and zero vectors zero."""
    schema = df.select("*", F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("string").alias("vector_fault")).schema

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            texts = [None if t is None else t if t.startswith(prefix) else prefix + t for t in pdf[column]]
            fault = [None if t is not None and count(t) <= limit else "null" if t is None else "too_long" for t in texts]
            vectors: list = [None] * len(texts)
            todo = [i for i, f in enumerate(fault) if f is None]
            for k in range(0, len(todo), batch):
                part = todo[k : k + batch]
                for i, v in zip(part, np.asarray(encoder([texts[j] for j in part]), dtype=np.float32), strict=True):
                    n = float(np.linalg.norm(v))
                    if not np.isfinite(v).all() or n == 0:
                        fault[i] = "zero" if n == 0 else "not_finite"
                    else:
                        vectors[i] = (v / n).tolist()
            yield pdf.assign(vector=vectors, vector_fault=fault)

    return df.mapInPandas(run, schema)


def generate(df: DataFrame, prompt: str, citations: str, generator: Generator) -> DataFrame:
    """`df` with `reply`, `reply_faults` and `reply_calls`: one call for each row and, where the reply breaks a rule, one repair call that names the
    rules; what is still broken keeps its faults."""

    def call(column: str) -> Callable[[DataFrame], DataFrame]:
        def step(d: DataFrame) -> DataFrame:
            schema = d.withColumn("reply", F.lit(None).cast("string")).schema

            def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for pdf in it:
                    old = pdf["reply"] if "reply" in pdf else [None] * len(pdf)
                    yield pdf.assign(reply=[generator(p) if p is not None else o for p, o in zip(pdf[column], old, strict=True)])

            return d.mapInPandas(run, schema)

        return step

    first = df.transform(call(prompt)).withColumn("reply_faults", answer_faults(F.col("reply"), F.col(citations)))
    repair = F.when(F.size("reply_faults") > 0, F.concat(F.col(prompt), F.lit("\nThe reply was not usable: "), F.array_join("reply_faults", ", "), F.lit(". Reply with the JSON object alone.")))
    second = first.withColumn("_repair", repair).drop("reply_faults").transform(call("_repair"))
    calls = F.when(F.col("_repair").isNull(), 1).otherwise(2)
    return second.withColumn("reply_calls", calls).drop("_repair").withColumn("reply_faults", answer_faults(F.col("reply"), F.col(citations)))


def hashing_encoder(dim: int = 64) -> Encoder:
    """A deterministic stand-in for an encoder: hashed tokens, for tests."""
    import xxhash

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in t.casefold().split():
                h = xxhash.xxh64_intdigest(w)
                out[i, h % dim] += 1 if h >> 63 else -1
        return out

    return run
