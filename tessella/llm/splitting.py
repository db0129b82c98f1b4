"""Splitting oversized passages at natural boundaries.

Method: lexical cohesion. Places where a cut is natural are line ends and sentence ends. At each of them, the bags of words of
the blocks of `block` tokens before and behind are compared by cosine; the depth of a place is how far its similarity lies
below the peaks on either side (the valley). Within each window of sizes that a piece may have, the deepest valley is
chosen; a window without any natural place is cut between tokens. Each piece begins with the last tokens of the one before.

Tokens are counted in the JVM and only passages above their limit go to Python, one row at a time.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.common import latest
from tessella.llm.tokens import token_count, token_spans

_LINE = regex.compile(r"[\r\n]+")
# A sentence ends behind a mark that is followed by a blank and by what may begin one. Before a digit a full stop mostly belongs to an
# abbreviation, and so it does behind a single letter, and behind a short word before a small letter.
_SENTENCE = regex.compile(r"(?:(?:(?<=\p{L}{5})[.!?؟।։]+[\"'”’»)\]]*(?=\s+[^\s\p{N}])|(?<![\s.(]\p{L})[.!?؟।։]+[\"'”’»)\]]*(?=\s+[^\s\p{Ll}\p{N}]))|[。！？｡][」』”’)）]*|…+(?=\s+\p{Lu})|(?<=\p{Thai})\s+(?=\p{Thai}))")
SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (("chunk_id", T.StringType()), ("piece", T.IntegerType()), ("start_char", T.IntegerType()), ("end_char", T.IntegerType()), ("overlap_tokens", T.IntegerType()), ("tokens", T.IntegerType()), ("max_tokens", T.IntegerType()), ("fits", T.BooleanType()), ("text", T.StringType()))]
)


def natural_places(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """Token numbers k such that a cut before token k is at a line end or sentence end."""
    starts = [a for a, _ in spans]
    ends = sorted({m.start() for m in _LINE.finditer(text)} | {m.end() for m in _SENTENCE.finditer(text)})
    return sorted({int(k) for k in np.searchsorted(starts, ends) if 0 < k < len(spans)})


def valley_depths(words: list[str], places: list[int], block: int) -> dict[int, float]:
    """Depth of the similarity valley at each place."""

    def cosine(k: int) -> float:
        a, b = Counter(words[max(0, k - block) : k]), Counter(words[k : k + block])
        dot = sum(n * b[w] for w, n in a.items())
        return dot / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values())) if dot else 0.0

    s = [cosine(k) for k in places]
    depths = {}
    for i, k in enumerate(places):
        left = right = i
        while left > 0 and s[left - 1] >= s[left]:
            left -= 1
        while right + 1 < len(s) and s[right + 1] >= s[right]:
            right += 1
        depths[k] = s[left] - s[i] + s[right] - s[i]
    return depths


def split_text(text: str, budget: int, overlap: int, block: int = 40, least: float = 0.5) -> list[tuple[int, int, int, int]]:
    """(start_char, end_char, overlap tokens, tokens) of the pieces of a text of more than `budget` tokens.

    The first piece begins at 0 and the last ends at the text's end; each other cut is at the start of a token. A
    piece with its overlap has at most `budget` tokens; where that can be had with a natural place, at least `least` of
    the budget's new tokens. An overlap that leaves no room for a new token is shortened to budget - 1.
    """
    budget = max(1, budget)
    overlap = max(0, min(overlap, budget - 1))
    spans = token_spans(text)
    n = len(spans)
    if n <= budget:
        return [(0, len(text), 0, n)]
    places = natural_places(text, spans)
    depths = valley_depths([text[a:b].casefold() for a, b in spans], places, block)
    at = np.array(places, dtype=np.int64)
    pieces, cut = [], 0
    while cut < n:
        before = min(overlap, cut)
        room = cut + budget - before
        if room >= n:
            end = n
        else:
            lo, hi = (int(np.searchsorted(at, x, side="right")) for x in (cut + math.floor((budget - before) * least), room))
            window = places[lo:hi]
            if window:
                end = max(window, key=lambda k: (depths[k], k))
            else:
                early = places[int(np.searchsorted(at, cut, side="right")) : hi]
                end = early[-1] if early else room
        start = 0 if cut == 0 else spans[cut - before][0]
        pieces.append((start, len(text) if end == n else spans[end][0], before, end - cut + before))
        cut = end
    return pieces


def oversized(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """(chunk_id, text, path_tokens, tokens, max_tokens) of the passages that, with their section's path, exceed their limit."""
    rows = latest(chunks, "chunk_id", "ingested_at", "section_id", "text", "max_tokens").filter("text is not null and max_tokens is not null")
    paths = latest(sections, "section_id", "written_at", "path").select("section_id", F.coalesce(token_count(F.array_join("path", " > ")), F.lit(0)).alias("path_tokens"))
    counted = rows.withColumn("tokens", token_count(F.col("text"))).join(paths, "section_id", "left").withColumn("path_tokens", F.coalesce("path_tokens", F.lit(0)))
    return counted.filter("path_tokens + tokens > max_tokens").select("chunk_id", "text", "path_tokens", "tokens", "max_tokens")


def split_oversized(chunks: DataFrame, sections: DataFrame, limits: DataFrame) -> DataFrame:
    """The pieces of every passage that exceeds its limit together with its section's path: chunk_id, piece (from 0),
    start_char and end_char (half-open code points of the passage), overlap_tokens, tokens (without the path), max_tokens,
    fits (path, line break and piece are within max_tokens), text.

    The overlap is that of the row chunk-<max_tokens> of `limits`, 0 where there is none. A section that is missing or has
    no path counts with an empty path. A path that alone fills the limit leaves pieces of one token with fits = false.
    Rows of a repeated chunk_id count once, the one delivered last; null ids, null texts and null limits are left out;
    further columns are ignored.
    """
    stated = limits.filter("limit_name like 'chunk-%'").groupBy(F.expr("try_cast(substring(limit_name, 7) as int)").alias("max_tokens")).agg(F.max("overlap_tokens").alias("overlap"))
    todo = oversized(chunks, sections).join(stated, "max_tokens", "left").select("chunk_id", "text", "path_tokens", "max_tokens", F.coalesce("overlap", F.lit(0)).alias("overlap"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for r in b.to_pylist():
                for k, (start, end, before, n) in enumerate(split_text(r["text"], r["max_tokens"] - r["path_tokens"], r["overlap"])):
                    rows.append((r["chunk_id"], k, start, end, before, n, r["max_tokens"], r["path_tokens"] + n <= r["max_tokens"], r["text"][start:end]))
            columns = list(zip(*rows, strict=True)) or [()] * 9
            types = (pa.string(), *[pa.int32()] * 6, pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=SCHEMA.fieldNames())

    return todo.mapInArrow(batches, SCHEMA)
