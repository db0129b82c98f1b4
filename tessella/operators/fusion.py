"""Weighted reciprocal-rank fusion of ranked lists, and hybrid retrieval on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.operators.dense import dense_search
from tessella.operators.lexical import Index, bm25_search

#: The four lists of a rewritten query in their order, with their weights.
REWRITE_WEIGHTS = (("original_bm25", 0.10), ("original_dense", 0.10), ("rewrite_bm25", 0.40), ("rewrite_dense", 0.40))


def weighted_rrf(lists: Sequence[tuple[str, DataFrame, float]], k: int = 5, rrf_k: int = 60) -> DataFrame:
    """(query_id, ordinal, score, rank, components) of the fused lists, each (name, DataFrame(query_id, ordinal, rank), weight).

    Weights are normalised by their sum; a list of weight 0 still gives membership. Ties go to what was seen first, going
    through the lists in order. One union and one aggregate on (query, document); a list's repeats add up.
    """
    if k < 1 or rrf_k < 1 or not lists or any(w < 0 for _, _, w in lists) or sum(w for _, _, w in lists) <= 0:
        raise ValueError("k and rrf_k must be positive, weights not negative and not all 0")
    total = sum(w for _, _, w in lists)
    parts = [df.select("query_id", "ordinal", F.lit(i).alias("_list"), F.lit(name).alias("_name"), F.col("rank").cast("int").alias("_rank"), (F.lit(w / total) / (F.lit(rrf_k) + F.col("rank"))).alias("_part")) for i, (name, df, w) in enumerate(lists)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    of_list = [F.sum(F.when(F.col("_list") == i, F.col("_part"))).alias(f"_p{i}") for i in range(len(lists))]
    fused = union.groupBy("query_id", "ordinal").agg(F.min(F.struct("_list", "_rank")).alias("_seen"), *of_list)
    score = sum((F.coalesce(F.col(f"_p{i}"), F.lit(0.0)) for i in range(1, len(lists))), F.coalesce(F.col("_p0"), F.lit(0.0)))
    components = F.map_filter(F.create_map(*[x for i, (name, _, _) in enumerate(lists) for x in (F.lit(name), F.col(f"_p{i}"))]), lambda _, v: v.isNotNull())
    ranked = fused.select("query_id", "ordinal", score.alias("score"), "_seen", components.alias("components"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "_seen")
    return ranked.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "ordinal", "score", "rank", "components")


def hybrid_search(index: Index, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, candidate_k: int = 20, final_k: int = 5) -> DataFrame:
    """Lexical and dense candidates at equal weights."""
    return weighted_rrf([("bm25", bm25_search(index, queries, candidate_k), 0.5), ("dense", dense_search(vectors, query_vectors, candidate_k), 0.5)], final_k)


def hybrid_search_with_rewrite(index: Index, vectors: DataFrame, original: tuple[DataFrame, DataFrame], rewritten: tuple[DataFrame, DataFrame], candidate_k: int = 20, final_k: int = 5) -> DataFrame:
    """Four lists: original and rewritten query, each lexical and dense. Each pair is (queries, query vectors)."""
    lists = [bm25_search(index, original[0], candidate_k), dense_search(vectors, original[1], candidate_k), bm25_search(index, rewritten[0], candidate_k), dense_search(vectors, rewritten[1], candidate_k)]
    return weighted_rrf([(n, df, w) for (n, w), df in zip(REWRITE_WEIGHTS, lists, strict=True)], final_k)
