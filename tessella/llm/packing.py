"""Filling fixed-capacity containers with documents.

Method: cost-balanced packing. A container is a training sequence; a document of n tokens costs linear*n + quadratic*n**2
(attention inside the document). Documents are assigned in descending order of size, each to the sequence of
lowest cost that has room for it; a new sequence is opened only when none has. A document longer than the
capacity is cut into pieces of exactly the capacity and a rest; no other document is cut. Balancing alone leaves a little
room in every sequence, too little for any document; so the smaller documents, half of all tokens, are assigned to
the sequence that they fill most tightly instead.

Sizes are counted in the JVM, so only (doc_id, piece, size) is shuffled. Documents are spread at random over shards of
about `shard` pieces and each shard is packed by itself: one shard is one bounded task, and the room lost by
not packing across shards is at most about one container a shard. In a shard, pieces of one size are interchangeable,
and a shard begins with as many empty sequences as its tokens need at least, so costs balance over all of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.common import blank, durable, spread
from tessella.llm.tokens import token_count, token_spans

SCHEMA = "doc_id bigint, piece int, first_token bigint, tokens bigint, container_id string"


def assign(sizes: np.ndarray, capacity: int, linear: float, quadratic: float, tail: float = 0.5) -> np.ndarray:
    """The sequence number of each size; sizes in descending order, none above the capacity. The sizes that make up the last `tail` of all
    tokens go where they fit most tightly."""
    n = max(1, math.ceil(int(sizes.sum()) / capacity))
    room, cost = np.zeros(2 * n + 64, dtype=np.int64), np.zeros(2 * n + 64)  # sequences from n on are not open yet
    room[:n] = capacity
    out = np.empty(len(sizes), dtype=np.int64)
    to_come = int(sizes.sum())
    balanced = tail * to_come
    for i, size in enumerate(sizes.tolist()):
        wish = cost[:n] if to_come > balanced else room[:n]
        to_come -= size
        k = int(np.argmin(np.where(room[:n] >= size, wish, np.inf)))
        if room[k] < size:
            if n == len(room):
                room, cost = np.append(room, np.zeros(n, dtype=np.int64)), np.append(cost, np.zeros(n))
            k, n = n, n + 1
            room[k] = capacity
        out[i] = k
        room[k] -= size
        cost[k] += linear * size + quadratic * size * size
    return out


def _shard(capacity: int, linear: float, quadratic: float) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        where = assign(pdf["tokens"].to_numpy(), capacity, linear, quadratic)
        return pdf.assign(container_id=[f"{key[0]}-{k}" for k in where])[["doc_id", "piece", "first_token", "tokens", "container_id"]]

    return run


def sizes(documents: DataFrame) -> DataFrame:
    """(doc_id, tokens) of the non-blank documents; a doc_id delivered more than once counts once, by its longest text."""
    full = spread(documents.filter("doc_id is not null").filter(~blank("text")).select("doc_id", "text"))
    return full.select(F.col("doc_id").cast("bigint").alias("doc_id"), token_count(F.col("text")).cast("bigint").alias("tokens")).groupBy("doc_id").agg(F.max("tokens").alias("tokens"))


def pack(documents: DataFrame, capacity: int, linear: float = 1.0, quadratic: float = 1 / 1024, shard: int = 8192) -> DataFrame:
    """(doc_id, piece, first_token, tokens, container_id): the container of every piece of every non-blank document.

    A document that fits has one piece (0). One above the capacity has pieces of `capacity` tokens and a rest; first_token is
    the piece's offset in tokens. Null and blank texts, and null ids, are left out. Further columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    pieces = sizes(documents).filter("tokens > 0").select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), F.ceil(F.col("tokens") / capacity).cast("int") - 1)).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece").cast("bigint") * capacity).alias("first_token"), F.least(F.lit(capacity).cast("bigint"), F.col("tokens") - F.col("piece").cast("bigint") * capacity).alias("tokens"))
    pieces = durable(pieces)  # a few bytes a document; counting them must not count all tokens again
    shards = max(1, math.ceil(pieces.count() / shard))
    return pieces.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards))).groupBy("_shard").applyInPandas(_shard(capacity, linear, quadratic), SCHEMA)


def piece_spans(text: str, capacity: int) -> list[tuple[int, int]]:
    """Half-open code point offsets of a text's pieces; white space between two pieces goes with the one before it."""
    spans = token_spans(text)
    cuts = [0, *(spans[i][0] for i in range(capacity, len(spans), capacity)), len(text)]
    return list(zip(cuts, cuts[1:], strict=False))
