"""Passages of bounded size with exact sources, and the proof that no text was lost."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessella.common import blank

_TOKEN = regex.compile(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f]")
_CJK = regex.compile(r"[㐀-䶿一-鿿豈-舘並-龎\U00020000-\U000323AF]")
_GAP = regex.compile(r"[\s\x1c-\x1f]+")
_BLANKS = regex.compile(r"[\s\x1c-\x1f]*")


def count_tokens(text: str) -> int:
    """The search tokenizer's count; the stand-in for a model's tokenizer, which is given as a callable."""
    return sum(len(m) if _CJK.search(m) else 1 for m in _TOKEN.findall(text))


def is_content(role: Column, text: Column) -> Column:
    """Blocks that go into passages: of role content (the default), with text."""
    return (F.coalesce(role, F.lit("content")) == "content") & ~blank(text)


def canonical_offsets(blocks: DataFrame) -> DataFrame:
    """(section_id, block_id, start_char, end_char): where each block stands in its section's text, blocks joined by a line break in order
    of ordinal. blocks: section_id, block_id, ordinal, text."""
    order = W.partitionBy("section_id").orderBy("ordinal", "block_id")
    size = F.length(F.coalesce("text", F.lit("")))
    at = F.coalesce(F.sum(size + 1).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return blocks.select("section_id", "block_id", at.cast("long").alias("start_char"), (at + size).cast("long").alias("end_char"))


def span_intersections(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows of both sides whose half-open spans overlap, with the overlap (start_char, end_char). Both have `on`, start_char and end_char;
    the join is on the equal key with the overlap as a condition, so no pair of different keys is made."""
    r = right.select(F.col(on), *[F.col(c).alias(f"_{c}") if c in ("start_char", "end_char") else F.col(c) for c in right.columns if c != on])
    j = left.join(r, on).filter("start_char < _end_char and _start_char < end_char")
    return j.withColumn("start_char", F.greatest("start_char", "_start_char")).withColumn("end_char", F.least("end_char", "_end_char")).drop("_start_char", "_end_char")


def coverage_gaps(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """(block_id, from_char, to_char): text of content blocks that no span covers. blocks: block_id, text (content only);
    spans: block_id, start_char, end_char. A gap counts only if what it skips is not blank; the tail is a gap like any other."""
    text = blocks.select("block_id", "text", F.length("text").alias("_n"))
    every = spans.select("block_id", F.col("start_char").cast("long"), F.col("end_char").cast("long")).unionByName(text.select("block_id", F.col("_n").cast("long").alias("start_char"), F.col("_n").cast("long").alias("end_char")))
    order = W.partitionBy("block_id").orderBy("start_char", "end_char").rowsBetween(W.unboundedPreceding, -1)
    cut = every.withColumn("_from", F.coalesce(F.max("end_char").over(order), F.lit(0))).filter("start_char > _from")
    skipped = F.expr("substring(text, cast(_from as int) + 1, cast(start_char - _from as int))")
    return cut.join(text, "block_id").filter("_from < _n").filter(~blank(skipped)).select("block_id", F.col("_from").alias("from_char"), F.col("start_char").alias("to_char"))


def budget_spans(text: str, budget: int, count: Callable[[str], int] = count_tokens) -> list[tuple[int, int]]:
    """Half-open spans that partition a text, each of at most `budget` tokens by `count`, ending behind white space where there is
    some in the second half of what fits. A single character above the budget is an error."""
    out, start, n = [], 0, len(text)
    while start < n:
        low, high = start, n
        while low < high:  # the longest prefix that fits; count grows with the prefix
            mid = (low + high + 1) // 2
            low, high = (mid, high) if count(text[start:mid]) <= budget else (low, mid - 1)
        end = low
        if end == start:
            raise ValueError("a character does not fit the budget")
        if end < n:
            gaps = [m.end() for m in _GAP.finditer(text, start, end)]
            if gaps and gaps[-1] - start > (end - start) // 2:
                end = gaps[-1]
        out.append((start, end))
        start = end
    return out


CHUNK = T.StructType([T.StructField("section_id", T.StringType()), T.StructField("piece", T.LongType()), T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType()), T.StructField("tokens", T.IntegerType()), T.StructField("text", T.StringType())])


def section_texts(blocks: DataFrame, stretch: int = 1_000_000) -> DataFrame:
    """(section_id, base, text): a section's blocks in order, joined by a line break.

    A section is the unit that is chunked; one of more than `stretch` characters comes in several rows, cut between blocks, each with
    the offset `base` of its beginning, so that no row and no task holds more than a stretch and a block.
    """
    order = W.partitionBy("section_id").orderBy("ordinal", "block_id")
    text = F.coalesce("text", F.lit(""))
    at = F.coalesce(F.sum(F.length(text) + 1).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.select("section_id", at.cast("long").alias("_at"), text.alias("text")).withColumn("_k", F.floor(F.col("_at") / stretch))
    rows = placed.groupBy("section_id", "_k").agg(F.min("_at").alias("base"), F.array_sort(F.collect_list(F.struct("_at", "text"))).alias("_b"))
    return rows.select("section_id", "base", F.array_join(F.transform("_b", lambda x: x["text"]), "\n").alias("text"))


def budget_chunks(sections: DataFrame, max_tokens: int = 384, count: Callable[[str], int] = count_tokens) -> DataFrame:
    """(section_id, piece, start_char, end_char, tokens, text) of sections (section_id, base, path, text). piece counts from the row's base,
    so it is unique and in order within a section. The prefix that the encoder sees with each passage counts against the budget. A
    section whose path alone fills it is refused: its row has piece -1, the empty span and the prefix's tokens, so the rest of the corpus
    is not lost with it."""
    if max_tokens < 1:
        raise ValueError("max_tokens must be positive")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for r in b.to_pylist():
                base = r["base"] or 0
                prefix = count("passage: " + " > ".join(x or "" for x in r["path"] or []))
                room = max_tokens - prefix
                if room < 1:
                    out.append((r["section_id"], -1, 0, 0, prefix, ""))
                    continue
                for k, (s, e) in enumerate(budget_spans(r["text"], room, count)):
                    out.append((r["section_id"], base + k, base + s, base + e, count(r["text"][s:e]), r["text"][s:e]))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), *[pa.int64()] * 3, pa.int32(), pa.string()), strict=True)], names=CHUNK.fieldNames())

    return sections.select("section_id", "base", "path", "text").mapInArrow(batches, CHUNK)


def align_segments(text: str, segments: list[str]) -> list[tuple[int, int]]:
    """Offsets of segments in order in a text from which they differ in white space only. Text that no segment holds, or a segment that
    is not found behind the one before, is an error; empty segments are passed over."""
    out, done = [], 0
    for s in segments:
        start = end = None
        for w in s.split():
            at = _BLANKS.match(text, done if end is None else end).end()
            if at == end or not text.startswith(w, at):
                raise ValueError("a segment cannot be aligned with the text")
            start, end = at if start is None else start, at + len(w)
        if end is not None:
            out.append((start, end))
            done = end
    if text[done:].strip():
        raise ValueError("the segments leave out text")
    return out


ALIGNED = T.StructType([T.StructField("key", T.StringType()), T.StructField("position", T.IntegerType()), T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType())])


def aligned(rows: DataFrame) -> DataFrame:
    """(key, position, start_char, end_char) of rows (key, text, segments array<string>)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = [(r["key"], k, s, e) for r in b.to_pylist() for k, (s, e) in enumerate(align_segments(r["text"] or "", [x or "" for x in r["segments"] or []]))]
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), *[pa.int32()] * 3), strict=True)], names=ALIGNED.fieldNames())

    return rows.select("key", "text", "segments").mapInArrow(batches, ALIGNED)
