"""Corpus counts: keys counted in Python within each Arrow batch, and summed by Spark."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A counter is handed on when it holds so many keys; this bounds a worker's memory and changes no result.
FLUSH = 200_000


def key_counts(df: DataFrame, update: Callable[[Counter, list], None], spell: Callable[[Any], str | None] = str) -> DataFrame:
    """(key, n): `update` adds the keys of a list of rows (tuples, or plain values for a single column) to a counter. Keys may be anything
    hashable; `spell` makes a string of each distinct one when it is handed on, or None for one that is not counted."""
    single = len(df.columns) == 1

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = b.column(0).to_pylist() if single else list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            counter: Counter = Counter()
            for j in range(0, len(rows), 50):
                update(counter, rows[j : j + 50])
                if len(counter) > FLUSH:
                    yield _batch(counter, spell)
                    counter = Counter()
            yield _batch(counter, spell)

    return df.mapInArrow(batches, "key string, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def _batch(counter: Counter, spell: Callable[[Any], str | None]) -> pa.RecordBatch:
    spelt = [(k, n) for k, n in ((spell(x), n) for x, n in counter.items()) if k is not None]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in spelt], pa.string()), pa.array([n for _, n in spelt], pa.int64())], names=["key", "n"])
