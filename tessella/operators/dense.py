"""Exact cosine search.

Queries are a stated set; they go to every partition of the vectors in blocks of bounded size and are scored by a matrix
product, one Arrow batch of vectors at a time. Each task keeps only the k best of each query, so k rows a query and
task are shuffled, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessella.functions.text import let


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def vector_fault(v: Column, dim: int | None = None) -> Column:
    """Why a vector cannot be stored or searched for: null, empty, dimension, not_finite or zero; null if it can."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = F.when(v.isNull(), "null").when(F.size(v) == 0, "empty")
    if dim is not None:
        out = out.when(F.size(v) != dim, "dimension")
    return out.when(bad, "not_finite").when(norm(v) == 0, "zero")


def normalize(v: Column) -> Column:
    """The vector at length 1, as floats; null for a vector with a fault."""
    return F.when(vector_fault(v).isNull(), let(norm(v), lambda n: F.transform(v, lambda x: (x.cast("double") / n).cast("float"))))


def mean_pool(states: Column, mask: Column) -> Column:
    """Mean of the token vectors (array<array<float>>) whose mask is 1, at length 1; of none the zero vector."""
    dim = F.size(F.element_at(states, 1))
    kept = F.filter(F.arrays_zip(states.alias("s"), mask.alias("m")), lambda z: z["m"] == 1)
    total = F.aggregate(kept, F.array_repeat(F.lit(0.0), dim), lambda acc, z: F.zip_with(acc, z["s"], lambda a, x: a + x.cast("double")))
    n = F.greatest(F.size(kept), F.lit(1))
    return let(F.transform(total, lambda x: x / n), lambda mean: let(norm(mean), lambda length: F.transform(mean, lambda x: F.when(length > 0, x / length).otherwise(0.0))))


RESULT = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("ordinal", T.LongType()), T.StructField("score", T.DoubleType())])


def dense_search(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = 4096) -> DataFrame:
    """(query_id, ordinal, score, rank) by cosine; ties go to the smaller ordinal. The 13th place, which depends on the order
    of summation, does not count.

    vectors: ordinal, vector; queries: query_id, vector. Vectors and queries with a fault are left out, as are vectors of another
    dimension than the query's. Queries are sent in blocks of at most `block`.
    """
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError("k must be a positive integer")
    sound = queries.filter(vector_fault(F.col("vector")).isNull()).select(F.col("query_id").cast("long").alias("query_id"), "vector")
    blocks = max(1, math.ceil(sound.count() / block))
    base = vectors.filter(vector_fault(F.col("vector")).isNull()).select(F.col("ordinal").cast("long").alias("ordinal"), F.col("vector").cast("array<double>").alias("vector"))
    sc = vectors.sparkSession.sparkContext
    out = None
    for i in range(blocks):
        rows = sound.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).collect()
        by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for d in {len(r["vector"]) for r in rows}:
            q = np.array([r["vector"] for r in rows if len(r["vector"]) == d], dtype=np.float64)
            by_dim[d] = np.array([r["query_id"] for r in rows if len(r["vector"]) == d]), q / np.linalg.norm(q, axis=1, keepdims=True)
        shared = sc.broadcast(by_dim)
        part = base.mapInArrow(_scorer(shared, k), RESULT)
        out = part if out is None else out.unionByName(part)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "ordinal")
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _scorer(shared, k: int):  # noqa: ANN001, ANN202
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in it:
            ids, column = b.column(0).to_numpy(), b.column(1)
            lengths = np.diff(column.offsets.to_numpy())
            values = column.flatten().to_numpy()
            starts = np.cumsum(lengths) - lengths
            for d, (qids, q) in shared.value.items():
                at = np.flatnonzero(lengths == d)
                for j in range(0, len(at), 1024):
                    rows = at[j : j + 1024]
                    m = values[starts[rows][:, None] + np.arange(d)]
                    s = np.round((m / np.linalg.norm(m, axis=1, keepdims=True)) @ q.T, 12).T  # queries x vectors
                    o = np.broadcast_to(ids[rows], s.shape)
                    if d in kept:
                        s, o = np.hstack([kept[d][0], s]), np.hstack([kept[d][1], o])
                    order = np.lexsort((o, -s), axis=1)[:, :k]
                    kept[d] = np.take_along_axis(s, order, 1), np.take_along_axis(o, order, 1)
        for d, (s, o) in kept.items():
            qids = np.repeat(shared.value[d][0], s.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(qids, pa.int64()), pa.array(o.ravel(), pa.int64()), pa.array(s.ravel(), pa.float64())], names=RESULT.fieldNames())

    return run


def scoped(vectors: DataFrame, scope: DataFrame, on: str) -> DataFrame:
    """The vectors whose key is in the scope: the filter comes before any scoring."""
    return vectors.join(scope.select(on).distinct(), on, "left_semi")
