"""Evaluation passages inside training documents.

Method: one Aho-Corasick automaton over the normalised evaluation items. Each item is cut into consecutive pieces of half a
window, so any `words` consecutive words (in languages written without spaces, `chars` consecutive characters) hold
one piece whole, and the automaton has no more states than the items have letters. Each document is normalised to its
letters and digits alone (white space, punctuation, markup, letter case and character width fall away) and scanned
once; from a piece that is met the text and the item are compared to both sides, which gives the longest stretch that they share.
Only where it is long enough are offsets mapped back to the original text, to give the place and to see that it begins
and ends at a word's edge.

The set of evaluation items is a stated query set. One automaton takes items of `capacity` letters together, which bounds a worker's
memory, the broadcast and the driver's share; a larger set is read in blocks of that size, one after another.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.common import durable, spread

# Languages whose passages are measured in characters.
BY_CHARACTER = ("zh", "ja", "th")
_MARKUP = regex.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->|&(?:[A-Za-z]+|#\d+|#[xX][0-9A-Fa-f]+);|\]\([^()\s]*\)", regex.S)
_OTHER = regex.compile(r"[^\p{L}\p{N}]+")
_UNIT = regex.compile(r"\X", regex.S)
SCHEMA = "doc_id bigint, item_id bigint, start_char int, end_char int"


def _fold(text: str) -> str:
    return text.casefold() if text.isascii() else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())


def letters(text: str) -> str:
    """Letters and digits of a text in one case and width, without markup."""
    if "<" in text or "&" in text or "](" in text:
        text = _MARKUP.sub(lambda m: " " * len(m[0]), text)
    return _OTHER.sub("", _fold(text))


def letters_at(text: str) -> tuple[str, list[int], list[int]]:
    """The same letters, taken character by character as they are seen, and for each where that character begins and ends in `text`."""
    text = _MARKUP.sub(lambda m: " " * len(m[0]), text)
    out, begin, end = [], [], []
    for m in _UNIT.finditer(text):
        x = _OTHER.sub("", _fold(m[0]))
        out.append(x)
        begin.extend([m.start()] * len(x))
        end.extend([m.end()] * len(x))
    return "".join(out), begin, end


class Item(NamedTuple):
    """An item's letters, and where its units (words, or characters) begin in them, with the end at last."""

    item_id: int
    letters: str
    starts: list[int]
    window: int
    by_words: bool


def prepared(item_id: int, text: str | None, lang: str | None, words: int, chars: int) -> Item:
    if (lang or "").strip().lower()[:2] in BY_CHARACTER:
        s = letters(text or "")
        return Item(item_id, s, list(range(len(s) + 1)), chars, False)
    run = [x for x in (letters(w) for w in _MARKUP.sub(" ", text or "").split()) if x]
    starts = [0]
    for x in run:
        starts.append(starts[-1] + len(x))
    return Item(item_id, "".join(run), starts, words, True)


def automaton(items: list[Item]) -> ahocorasick.Automaton | None:
    """The pieces of all items that hold a window. Each pattern holds its length and ((item's number, place in its letters), ...)."""
    found: dict[str, list[tuple[int, int]]] = {}
    for k, item in enumerate(items):
        if len(item.starts) <= item.window:
            continue
        half = max(1, item.window // 2)
        for i in range(0, len(item.starts) - half, half):
            a, b = item.starts[i], item.starts[i + half]
            found.setdefault(item.letters[a:b], []).append((k, a))
    if not found:
        return None
    a = ahocorasick.Automaton()
    for piece, owners in found.items():
        a.add_word(piece, (len(piece), tuple(owners)))
    a.make_automaton()
    return a


def _shared(s: str, i: int, t: str, j: int, step: int) -> int:
    """Number of characters that s from i and t from j have in common, in the given direction."""
    n = 0
    while 0 <= i < len(s) and 0 <= j < len(t) and s[i] == t[j]:
        i, j, n = i + step, j + step, n + 1
    return n


def scan(text: str, a: ahocorasick.Automaton, items: list[Item]) -> dict[int, tuple[int, int]]:
    """item_id -> half-open offsets in `text` of the first stretch that an item shares with it."""
    found = _stretches(letters(text), a, items)
    if not found:
        return {}
    s, begin, end = letters_at(text)
    if s != letters(text):  # a composition across characters: the form whose places are known counts
        found = _stretches(s, a, items)
    out: dict[int, tuple[int, int]] = {}
    for k, at, i, j in sorted(found, key=lambda x: x[1]):
        item = items[k]
        shift = at - item.starts[i]
        if item.by_words:  # both ends must be a word's edge in the text as well
            while i < j and not _begins(begin, end, item.starts[i] + shift):
                i += 1
            while i < j and not _ends(begin, end, item.starts[j] + shift - 1):
                j -= 1
        if j - i >= item.window:
            out.setdefault(item.item_id, (begin[item.starts[i] + shift], end[item.starts[j] + shift - 1]))
    return out


def _begins(begin: list[int], end: list[int], at: int) -> bool:
    return at == 0 or end[at - 1] < begin[at]


def _ends(begin: list[int], end: list[int], at: int) -> bool:
    return at + 1 == len(begin) or end[at] < begin[at + 1]


def _stretches(s: str, a: ahocorasick.Automaton, items: list[Item]) -> list[tuple[int, int, int, int]]:
    """(item's number, place in s, first unit, unit behind the last) of the longest common stretches of at least a window of whole units."""
    out = []
    reached: dict[tuple[int, int], int] = {}
    for last, (n, owners) in a.iter(s):
        for k, o in owners:
            p = last - n + 1
            if reached.get((k, p - o), 0) > last:
                continue  # inside a stretch that is known
            item = items[k]
            left = _shared(s, p - 1, item.letters, o - 1, -1)
            right = _shared(s, p + n, item.letters, o + n, 1)
            reached[k, p - o] = p + n + right
            i, j = bisect_left(item.starts, o - left), bisect_right(item.starts, o + n + right) - 1
            if j - i >= item.window:
                out.append((k, item.starts[i] + p - o, i, j))
    return out


#: A worker's automaton and items, with the rows that they were built of.
_built: list = [None, None, None]


def find_leaks(documents: DataFrame, items: DataFrame, words: int = 12, chars: int = 20, capacity: int = 5_000_000) -> DataFrame:
    """(doc_id, item_id, start_char, end_char): every document that holds at least `words` consecutive words of an item's
    text (`chars` consecutive characters in zh, ja and th), with the half-open offsets of the first such stretch.

    Null and blank texts hold nothing. Items without text or shorter than a window leak nowhere. Documents delivered
    under the same doc_id give each pair once. An item_id delivered more than once counts with all its texts. Further
    columns are ignored. An empty table on either side gives an empty result.
    """
    items = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("bigint"), "lang", "text").distinct()
    blocks = max(1, math.ceil((items.agg(F.sum(F.length("text"))).head()[0] or 0) / capacity))
    docs = spread(documents.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    out = None
    for k in range(blocks):
        some = [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]
        shared = documents.sparkSession.sparkContext.broadcast(some)

        def batches(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            if _built[0] is not shared.value:
                every = [prepared(i, t, lang, words, chars) for i, lang, t in shared.value]
                _built[:] = shared.value, automaton(every), every
            _, a, every = _built
            for b in it if a else ():
                rows = [(d, item, *at) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for item, at in scan(t, a, every).items()]
                columns = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "start_char", "end_char"])

        part = docs.mapInArrow(batches, SCHEMA)
        if blocks > 1:  # a block leaves the driver before the next one comes
            part = durable(part)
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.min(F.struct("start_char", "end_char")).alias("_s")).select("doc_id", "item_id", "_s.*")
