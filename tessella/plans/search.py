"""Retrieval queries with their SQL. The query set is every document whose doc_id is divisible by 100, asked by its title against
all documents; its vector is the embedding of the same number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.common import latest, spread, table
from tessella.functions import text as X
from tessella.operators import dense, fusion, lexical


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), "text"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("doc_id % 100 = 0")
    return d.select(F.col("doc_id").alias("query_id"), F.coalesce("title", "source_filename", F.lit("")).alias("text"))


def rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rewrite is a fixture: title and language of the document."""
    d = table(spark, sf_dir, "documents").filter("doc_id % 100 = 0")
    return d.select(F.col("doc_id").alias("query_id"), F.concat_ws(" ", F.coalesce("title", "source_filename"), "lang").alias("text"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ordinal"), F.col("embedding").alias("vector"), "label")


def asked_vectors(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter(f"(vec_id - {shift}) % 100 = 0 and vec_id >= {shift}").select((F.col("vec_id") - shift).alias("query_id"), F.col("embedding").alias("vector"))


def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.tokenize("text")
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.size(t).alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


def bm25_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.term_frequencies(corpus(spark, sf_dir))


def bm25_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.build_index(corpus(spark, sf_dir)).terms.select("term", "df")


def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.build_index(corpus(spark, sf_dir)).terms.select("term", F.round("idf", 9).alias("idf"))


def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.build_index(corpus(spark, sf_dir)).statistics.select("n", F.round("average", 6).alias("average"))


def _rounded(ranked: DataFrame, places: int) -> DataFrame:
    """Only what is shown is rounded, behind the ranking."""
    return ranked.withColumn("score", F.round("score", places))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = asked(spark, sf_dir)
    return _rounded(lexical.bm25_search(lexical.build_index(corpus(spark, sf_dir), lexical.query_terms(q)), q), 9)


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(dense.dense_search(vectors(spark, sf_dir), asked_vectors(spark, sf_dir)), 9)


def scoped_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope: the vectors that share a label with vector 0."""
    v = vectors(spark, sf_dir)
    return _rounded(dense.dense_search(dense.scoped(v, v.filter("ordinal = 0"), "label"), asked_vectors(spark, sf_dir), 10), 9)


def vector_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    doubled = F.transform("embedding", lambda x: x * 2)
    return v.select("vec_id", F.transform(dense.normalize(doubled), lambda x: F.round(x.cast("double"), 5) + 0.0).alias("vector"))


def mean_pool_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token states are a vector, its double and a masked one."""
    v = table(spark, sf_dir, "embeddings")
    states = F.array(F.col("embedding"), F.transform("embedding", lambda x: x * 2), F.transform("embedding", lambda x: x * 0 + 1))
    return v.select("vec_id", F.transform(dense.mean_pool(states, F.array(F.lit(1), F.lit(1), F.lit(0))), lambda x: F.round(x, 5) + 0.0).alias("vector"))


def _two_way(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    q = asked(spark, sf_dir)
    return fusion.hybrid_search(lexical.build_index(corpus(spark, sf_dir), lexical.query_terms(q)), vectors(spark, sf_dir), q, asked_vectors(spark, sf_dir), final_k=k)


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_way(spark, sf_dir, 5).select("query_id", "ordinal", F.round("score", 9).alias("score"), "rank")


def rrf_two_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the share of each list in the score."""
    return _two_way(spark, sf_dir, 5).select("query_id", "ordinal", "rank", F.round(F.coalesce(F.col("components")["bm25"], F.lit(0.0)), 9).alias("bm25_part"), F.round(F.coalesce(F.col("components")["dense"], F.lit(0.0)), 9).alias("dense_part"))


def ablation_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cut-off from 1 to 20 of the same ranking."""
    cut = spark.range(1, 21).select(F.col("id").cast("int").alias("final_k"))
    return _two_way(spark, sf_dir, 20).join(F.broadcast(cut), F.col("rank") <= F.col("final_k")).groupBy("query_id", "final_k").agg(F.count("*").alias("results"), F.round(F.sum("score"), 8).alias("mass"))  # 20 rows


def _four_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, r = asked(spark, sf_dir), rewritten(spark, sf_dir)
    index = lexical.build_index(corpus(spark, sf_dir), lexical.query_terms(q.unionByName(r)))
    return fusion.hybrid_search_with_rewrite(index, vectors(spark, sf_dir), (q, asked_vectors(spark, sf_dir)), (r, asked_vectors(spark, sf_dir, 1)))


def hybrid_search_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _four_way(spark, sf_dir).select("query_id", "ordinal", F.round("score", 9).alias("score"), "rank")


def rrf_four_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _four_way(spark, sf_dir).select("query_id", "ordinal", "rank", F.size("components").alias("lists"))


def retrieval_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical projection and embedding input of every chunk, by the valid rows of its section and manual."""
    chunks = latest(table(spark, sf_dir, "chunks"), "chunk_id", "ingested_at", "doc_id", "section_id", "text")
    docs = latest(table(spark, sf_dir, "bundle_documents"), "doc_id", "registered_at", "title", "source_filename").select("doc_id", "title", "source_filename")
    paths = latest(table(spark, sf_dir, "sections"), "section_id", "written_at", "path").select("section_id", "path")
    joined = chunks.join(docs, "doc_id", "left").join(paths, "section_id", "left")
    r = X.retrieval_text(F.col("title"), F.col("source_filename"), F.col("path"), F.col("text"))
    return joined.select("chunk_id", F.md5(X.indexed_text(r, F.col("text"))).alias("retrieval_md5"), F.md5(X.embedding_text(F.col("path"), F.col("text"))).alias("embedding_md5"))


_TOKEN = X.TOKEN.replace("'", "''")


def sql_tokens(c: str) -> str:
    return rf"flatten(list_transform(regexp_extract_all(coalesce({c}, ''), '{_TOKEN}'), lambda t: CASE WHEN regexp_matches(t, '{X.CJK}') THEN list_transform(string_split(t, ''), lambda x: replace(replace(lower(x), 'ß', 'ss'), 'ς', 'σ')) ELSE [replace(replace(lower(t), 'ß', 'ss'), 'ς', 'σ')] END))"


_TOK = f"tok AS (SELECT doc_id AS ordinal, {sql_tokens('text')} AS t FROM documents)"
_POST = f"""{_TOK},
tf AS (SELECT ordinal, term, count(*) AS tf FROM (SELECT ordinal, unnest(t) AS term FROM tok) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(t)) AS average FROM tok),
df AS (SELECT term, count(*) AS df, ln(1 + ((SELECT n FROM st) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf GROUP BY 1)"""


def _sql_bm25(name: str, query: str) -> str:
    """CTEs <name>(query_id, ordinal, score, rank), the 20 best."""
    return f"""{name}_q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT doc_id AS query_id, unnest({sql_tokens(query)}) AS term FROM documents WHERE doc_id % 100 = 0) GROUP BY ALL),
{name}_s AS (SELECT query_id, ordinal, round(sum(qtf * idf * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(t) / average)))), 12) AS score
  FROM {name}_q JOIN df USING (term) JOIN tf USING (term) JOIN tok USING (ordinal), st GROUP BY 1, 2),
{name} AS (SELECT d.doc_id AS query_id, o.ordinal, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY d.doc_id ORDER BY coalesce(score, 0) DESC, o.ordinal) AS rank
  FROM (SELECT doc_id FROM documents WHERE doc_id % 100 = 0) d CROSS JOIN (SELECT ordinal FROM tok) o LEFT JOIN {name}_s s ON s.query_id = d.doc_id AND s.ordinal = o.ordinal QUALIFY rank <= 20)"""


def _sql_dense(name: str, shift: int = 0, scope: str = "true", k: int = 20) -> str:
    return f"""{name} AS (SELECT q.vec_id - {shift} AS query_id, v.vec_id AS ordinal, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 12) DESC, v.vec_id) AS rank
  FROM embeddings q, embeddings v WHERE (q.vec_id - {shift}) % 100 = 0 AND q.vec_id >= {shift} AND {scope} QUALIFY rank <= {k})"""


def _sql_fused(lists: list[tuple[str, float]], k: int) -> str:
    union = " UNION ALL ".join(f"SELECT query_id, ordinal, {i} AS l, rank AS r, {w} / (60 + rank) AS p FROM {n}" for i, (n, w) in enumerate(lists))
    parts = ", ".join(f"coalesce(sum(p) FILTER (l = {i}), 0) AS p{i}" for i in range(len(lists)))
    total = " + ".join(f"p{i}" for i in range(len(lists)))
    return f"""fused AS (SELECT query_id, ordinal, min(struct_pack(l := l, r := r)) AS seen, count(DISTINCT l) AS lists, {parts} FROM ({union}) GROUP BY 1, 2),
best AS (SELECT *, {total} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {total} DESC, seen) AS rank FROM fused QUALIFY rank <= {k})"""


_TITLE = "coalesce(title, source_filename, '')"
_TWO = f"WITH {_POST}, {_sql_bm25('b', _TITLE)}, {_sql_dense('e')}, "
_FOUR = f"WITH {_POST}, {_sql_bm25('b', _TITLE)}, {_sql_dense('e')}, " + _sql_bm25("rb", "concat_ws(' ', coalesce(title, source_filename), lang)") + f", {_sql_dense('re', 1)}, "
_W2 = [("b", 0.5), ("e", 0.5)]
_W4 = [("b", 0.1), ("e", 0.1), ("rb", 0.4), ("re", 0.4)]

SQL = {
    "tokenize": f"WITH {_TOK} SELECT ordinal AS doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM tok",
    "bm25_tf": f"WITH {_POST} SELECT ordinal, term, tf, len(t) AS length FROM tf JOIN tok USING (ordinal)",
    "bm25_df": f"WITH {_POST} SELECT term, df FROM df",
    "bm25_idf": f"WITH {_POST} SELECT term, round(idf, 9) AS idf FROM df",
    "bm25_stats": f"WITH {_POST} SELECT n, round(average, 6) AS average FROM st",
    "bm25_topk": f"WITH {_POST}, {_sql_bm25('b', _TITLE)} SELECT query_id, ordinal, round(score, 9) AS score, rank FROM b",
    "dense_topk": f"WITH {_sql_dense('e')} SELECT * FROM e",
    "scoped_dense_topk": "WITH " + _sql_dense("e", 0, "v.label = (SELECT label FROM embeddings WHERE vec_id = 0)", 10) + " SELECT * FROM e",
    "vector_normalize": "SELECT vec_id, list_transform(embedding, lambda x: round((x * 2 / sqrt(list_sum(list_transform(embedding, lambda y: 4 * y::DOUBLE * y::DOUBLE))))::FLOAT::DOUBLE, 5) + 0.0::DOUBLE) AS vector FROM embeddings",
    "mean_pool_l2": "SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 5) + 0.0::DOUBLE) AS vector FROM embeddings",
    "hybrid_search": _TWO + _sql_fused(_W2, 5) + " SELECT query_id, ordinal, round(score, 9) AS score, rank FROM best",
    "rrf_two_way": _TWO + _sql_fused(_W2, 5) + " SELECT query_id, ordinal, rank, round(p0, 9) AS bm25_part, round(p1, 9) AS dense_part FROM best",
    "ablation_topk": _TWO + _sql_fused(_W2, 20) + " SELECT query_id, k::INT AS final_k, count(*) AS results, round(sum(score), 8) AS mass FROM best, range(1, 21) r(k) WHERE rank <= k GROUP BY 1, 2",
    "hybrid_search_rewrite": _FOUR + _sql_fused(_W4, 5) + " SELECT query_id, ordinal, round(score, 9) AS score, rank FROM best",
    "rrf_four_way": _FOUR + _sql_fused(_W4, 5) + " SELECT query_id, ordinal, rank, lists FROM best",
    "retrieval_text": """WITH c AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC) = 1),
d AS (SELECT * FROM bundle_documents QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY registered_at DESC) = 1),
s AS (SELECT section_id, array_to_string(path, ' > ') AS p FROM sections QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY written_at DESC) = 1)
SELECT chunk_id, md5('document title: ' || coalesce(d.title, '') || chr(10) || 'filename: ' || coalesce(source_filename, '') || chr(10) || 'section path: ' || coalesce(p, '') || chr(10) || coalesce(text, '')) AS retrieval_md5,
  md5('passage: ' || coalesce(p, '') || chr(10) || coalesce(text, '')) AS embedding_md5 FROM c LEFT JOIN d USING (doc_id) LEFT JOIN s USING (section_id)""",
}

QUERIES = {f.__name__: f for f in (tokenize, bm25_tf, bm25_df, bm25_idf, bm25_stats, bm25_topk, dense_topk, scoped_dense_topk, vector_normalize, mean_pool_l2, hybrid_search, rrf_two_way, ablation_topk, hybrid_search_rewrite, rrf_four_way, retrieval_text)}
