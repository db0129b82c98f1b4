"""Keyword-stuffed pages, link lists and tag lists.

Method: mean pointwise mutual information of neighbouring words, from counts over the whole corpus, and excess repetition
of neighbouring words. Pointwise mutual information is normalised by the pair's own information, so that pairs of rare and
of frequent words compare. Words and pairs are counted once a page, pages of the same text count once together, and a
page's own occurrence is left out of the count that it is judged by, so no page vouches for its own repeats: a pair that
no other page holds tells nothing.

Pages are judged in stretches of about `stretch` words, so a page's length makes no difference. A stretch is filler if

* links and tags are more than half of it; or
* at least `repeated` of its neighbouring pairs are repeats of a pair that came before in it, and, on average over all such
  stretches of the page, the mean information of distinct pairs, less half of that of words some places apart, is below
  what the `low` part of all pairs of the corpus have. Sentences that are repeated hold pairs as informative as any sentence; in keywords that are repeated neighbours tell
  little of each other, and hardly more than words that are no neighbours; or
* it repeats less, and on average over all such stretches of the page that information is below SALAD of this, from EVIDENCE pairs at least:
  of a new subject only pairs of common words are known, which tell less than others do, but more than words in no order.

A page is filler if filler stretches, and the links and tags of others, are clearly more than half of its words (MOSTLY).

Plan: one scan counts, one scan judges. Words and pairs are 64-bit hashes throughout. The counts are a table, in which the pairs
of every stretch are looked up. Pairs that make up at least 1/`heavy` of all, which are at most `heavy`
rows whatever the corpus, are sent to the workers: no hot key reaches a join. A table of at most SENT pairs is sent as a whole; of a larger one
all other pairs are joined, but for those that no two pages hold: a bitmap of bounded size is sent that tells of most of them, and what
it lets through in vain finds nothing in the join. Pages of which all is known in the task, and which are no filler, are not written down.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.common import blank, durable, spread

_TOKEN = regex.compile(r"</?a\b|href=[\"']?[^\s\"'<>]*[\"']?>?|(?:https?://|www\.)[^\s<>|*()\]]+|[#＃]\w+|\p{Han}{1,4}|\p{Hiragana}+|[\p{Katakana}ー]+|\p{L}[\p{L}\p{M}'’]*|\p{N}+")
LINK, TAG, NUMBER = "<link>", "<tag>", "0"
#: The part of the information of a pair turned round that is taken off.
TURNED = 0.5
#: What is left of the bound for stretches that hardly repeat, and the known pairs that a page's must have together.
SALAD, EVIDENCE = 1 / 3, 15
#: Above what the order of summation and the parts' 32 bits change in a mean.
ROUNDING = 1e-6
#: Bits of the bitmap for each pair, and at most (a power of 2); both change no result.
BITS, MOST_BITS = 16, 1 << 26
#: A link or tag counts as so many words, as many as the words around it.
WEIGHT = 3
#: The part of a page's words that makes it filler: above half, so that one of two stretches is not enough.
MOSTLY = 0.55
#: Characters that are worked on at once, and entries of a worker's caches; both change no result.
AT_ONCE, CACHED = 8_000_000, 500_000
#: Distinct repeated texts, and pairs, that are sent to all tasks; more of them are joined.
SENT = 1_000_000


class Reader:
    """Turns texts into arrays of word numbers. Numbers hold within one call of read(); hashes[number] is the word's hash."""

    def __init__(self) -> None:
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.hashes: list[int] = []
        self.chunks: dict[str, tuple[int, ...]] = {}
        for w in (LINK, TAG):
            self._number(w)

    def _number(self, word: str) -> int:
        k = self.numbers.get(word)
        if k is None:
            k = self.numbers[word] = len(self.hashes)
            self.hashes.append(xxhash.xxh64_intdigest(word))
        return k

    def _words(self, chunk: str) -> tuple[int, ...]:
        out: list[int] = []
        for token in _TOKEN.findall(chunk.casefold()):
            if token in ("<a", "</a"):
                continue
            if token.startswith(("href=", "http://", "https://", "www.")):
                out += [0] * WEIGHT
            elif token[0] in "#＃":
                out += [1] * WEIGHT
            else:
                out.append(self._number(NUMBER if token[0].isnumeric() else token))
        words = tuple(out)
        if len(chunk) <= 40:
            self.chunks[chunk] = words
        return words

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts, one after another, and the number of words of each. Words are in lower case, numbers are all one
        word; without blanks a word is a run of one Japanese syllabary, or up to four ideographs."""
        if len(self.hashes) > CACHED or len(self.chunks) > CACHED:
            self._clear()
        out: list[int] = []
        lengths = []
        get, take = self.chunks.get, self._words
        for t in texts:
            n = len(out)
            for chunk in t.split():
                words = get(chunk)
                out += take(chunk) if words is None else words
            lengths.append(len(out) - n)
        return np.array(out, dtype=np.int64), np.array(lengths, dtype=np.int64)

    def hashed(self, numbers: np.ndarray) -> np.ndarray:
        return np.array([self.hashes[i] for i in numbers.tolist()], dtype=np.uint64)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit hash of two, which depends on their order."""
    with np.errstate(over="ignore"):
        k = a * np.uint64(0x9E3779B97F4A7C15) + (b << np.uint64(31) | b >> np.uint64(33))
        k ^= k >> np.uint64(33)
        k *= np.uint64(0xFF51AFD7ED558CCD)
        return k ^ k >> np.uint64(33)


def portions(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in portions of about AT_ONCE bytes of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(ends):
        at = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + AT_ONCE, side="right"))
        end = max(begin + 1, at)
        yield b.slice(begin, end - begin)
        begin = end


#: A worker's reader.
_reader: list[Reader] = []


def reader() -> Reader:
    if not _reader:
        _reader.append(Reader())
    return _reader[0]


def stretches(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its page and its stretch, counted over all pages; and the first stretch of each page. Stretches are equal parts of a
    page of about `size` words; no word is left out."""
    pages = np.repeat(np.arange(len(lengths)), lengths)
    parts = np.maximum(1, np.rint(lengths / size).astype(np.int64))
    first = np.cumsum(parts) - parts
    inside = np.arange(len(pages)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return pages, first[pages] + ((inside + 1) * parts[pages] - 1) // np.maximum(1, lengths[pages]), first


def count_batch(texts: list[str], copies: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, a, b, n): number of pages of each word (a, b = 0) and of each pair of neighbouring words that are no link or tag."""
    r = reader()
    w, lengths = r.read(texts)
    v, weight = len(r.hashes), 1.0 / copies
    page = np.repeat(np.arange(len(texts)), lengths)
    once = np.unique(page * v + w)
    n_words = np.bincount(once % v, weight[once // v], minlength=v)
    met = np.flatnonzero(n_words)
    hashes = r.hashed(met)
    at = np.zeros(v, dtype=np.int64)
    at[met] = np.arange(len(met))
    next_to = (page[1:] == page[:-1]) & (w[1:] > 1) & (w[:-1] > 1)
    codes, which = np.unique(w[:-1][next_to] * v + w[1:][next_to], return_inverse=True)
    size = max(1, len(codes))
    once = np.unique(page[1:][next_to] * size + which)
    n_pairs = np.bincount(once % size, weight[once // size], minlength=len(codes))
    a, b = hashes[at[codes // v]], hashes[at[codes % v]]
    none = np.zeros(len(met), dtype=np.uint64)
    return np.r_[hashes, pair_hash(a, b)].view(np.int64), np.r_[none, a].view(np.int64), np.r_[none, b].view(np.int64), np.r_[n_words[met], n_pairs]


def page_counts(docs: DataFrame) -> DataFrame:
    """(key, a, b, n) over all pages of docs(text, copies), a page that has c copies counting 1/c each."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in portions(whole, 0):
                columns = count_batch(b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "a", "b", "n"])

    return docs.mapInArrow(batches, "key bigint, a bigint, b bigint, n double").groupBy("key", "a", "b").agg(F.round(F.sum("n")).cast("bigint").alias("n"))


def pair_information(counts: DataFrame) -> DataFrame:
    """(key, n, npmi) of the pairs that two pages hold: normalised pointwise mutual information, one page left out."""
    kind = F.col("a") == 0
    total = counts.agg(F.sum(F.when(kind, F.col("n"))), F.sum(F.when(~kind, F.col("n")))).head()
    n1, n2 = float(total[0] or 1), float(total[1] or 1)
    words = counts.filter(kind)
    pairs = counts.filter(~kind & (F.col("n") >= 2))
    joined = pairs.join(words.select(F.col("key").alias("a"), F.col("n").alias("na")), "a").join(words.select(F.col("key").alias("b"), F.col("n").alias("nb")), "b")
    p = (F.col("n") - 1) / n2
    return joined.select("key", "n", ((F.log(p) - F.log(F.col("na") / n1) - F.log(F.col("nb") / n1)) / -F.log(p)).alias("npmi"))


STEPS, OF_MEAN = 1000, 0.75
STRETCH = "doc_id bigint, page bigint, part int, total int, words int, sure int, asked boolean, again double, known double, told double, others array<struct<key:bigint,part:float>>"


def lower_part(information: DataFrame, low: float) -> float:
    """What the `low` part of all pairs, each as often as pages hold it, has less information than, but at most OF_MEAN of their mean: where all
    pairs are alike the low part is not apart from the rest. 0 if there is no pair. Only sums by thousandths come to the driver."""
    sums = sorted(information.groupBy(F.floor(F.col("npmi") * STEPS).alias("k")).agg(F.sum("n")).collect())
    total, at = sum(n for _, n in sums), 0
    mean = sum((k + 0.5) * n for k, n in sums) / STEPS / max(1, total)
    for k, n in sums:
        at += n
        if at >= low * total:
            return min((k + 1) / STEPS, OF_MEAN * mean)
    return 0.0


def bitmap(keys: DataFrame) -> np.ndarray:
    """Bits, 64 in a number, of which those of all keys (key) are set; as many as there is room for, not fewer than 64."""
    bits = min(MOST_BITS, 1 << max(6, (keys.count() * BITS).bit_length()))
    place = F.col("key").bitwiseAND(F.lit(bits - 1))
    rows = keys.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 AS int))")).alias("set")).toPandas()  # at most MOST_BITS / 64 rows
    out = np.zeros(bits // 64, dtype=np.int64)
    out[rows["at"].to_numpy(np.int64)] = rows["set"].to_numpy(np.int64)
    return out


def may_hold(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False only for keys that are not in the bitmap."""
    return (held[(keys & (64 * len(held) - 1)) >> 6] >> (keys & 63) & 1).astype(bool)


def judge_batch(texts: list[str], length: int, repeated: float, keys: np.ndarray, values: np.ndarray, held: np.ndarray | None = None) -> tuple:
    """The stretches that are, or may be, filler in whole or part: page, part, words of the page, words, those that are filler for sure,
    whether its pairs decide, the part of its pairs that repeat, the part of its distinct pairs that have a given key and what these
    tell, and the others' keys and parts of the mean with their offsets. Pairs decide in stretches that repeat at least `repeated` of them;
    others that are not in the bitmap `held` are left out."""
    r = reader()
    w, lengths = r.read(texts)
    page, at, first = stretches(lengths, length)
    n, v = int(at[-1]) + 1 if len(at) else 0, len(r.hashes)
    owner = np.zeros(n, dtype=np.int64)
    owner[at] = page
    words, marks = np.bincount(at, minlength=n), np.bincount(at[w <= 1], minlength=n)

    inside = at[1:] == at[:-1]
    codes, which = np.unique(w[:-1][inside] * v + w[1:][inside], return_inverse=True)
    size = max(1, len(codes))
    once = np.unique(at[1:][inside] * size + which)
    where, code = once // size, codes[once % size]
    pairs, linked = np.bincount(at[1:][inside], minlength=n), 2 * marks > words
    again = (pairs - np.bincount(where, minlength=n)) / np.maximum(1, pairs)
    kept = (~linked & (again >= repeated))[where] & (code // v > 1) & (code % v > 1)
    where, code = where[kept], code[kept]
    count = np.bincount(where, minlength=n)
    asked, part = count > 0, 1.0 / count[where]
    where, code, part = np.tile(where, 2), np.r_[code, code % v * v + code // v], np.r_[part, -TURNED * part]
    need, which = np.unique(code, return_inverse=True)
    hashed = pair_hash(r.hashed(need // v), r.hashed(need % v)).view(np.int64)
    spot = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
    sent = keys[spot] == hashed if len(keys) else np.zeros(len(hashed), dtype=bool)
    value = np.where(sent, values[spot], 0.0) if len(keys) else np.zeros(len(hashed))
    told = np.bincount(where, value[which] * part, minlength=n)
    known = np.bincount(where, sent[which] * np.maximum(0, part), minlength=n)
    left = np.flatnonzero((~sent if held is None else ~sent & may_hold(held, hashed))[which])
    left = left[np.argsort(where[left], kind="stable")]
    keep = np.flatnonzero((marks > 0) | asked)
    offsets = np.r_[0, np.cumsum(np.bincount(where[left], minlength=n)[keep])].astype(np.int32)
    sure = np.where(linked, words, marks)
    return owner[keep], (np.arange(n) - first[owner])[keep], lengths[owner[keep]], words[keep], sure[keep], asked[keep], again[keep], known[keep], told[keep], hashed[which[left]], part[left].astype(np.float32), offsets


def undecided(owner: np.ndarray, words: np.ndarray, sure: np.ndarray, asked: np.ndarray, again: np.ndarray, known: np.ndarray, told: np.ndarray, left: np.ndarray, repeated: float, cut: float) -> np.ndarray:
    """Stretches that may add to their page's filler: they hold some for sure, or repeat themselves, or the others of the page, of which `left` pairs
    are to be looked up, may be salad."""
    hardly = asked & (again < repeated)
    of_page = lambda v: np.bincount(owner[hardly], v[hardly], minlength=int(owner[-1]) + 1 if len(owner) else 0)
    salad = of_page(told * words) <= SALAD * cut * of_page(known * words) + 1e-9  # rounding is left to the sum over the page
    return (sure > 0) | (asked & ~hardly) | (hardly & (salad & (of_page(known * words) >= EVIDENCE - 1e-9) | (of_page(left) > 0))[owner])


def find_filler(documents: DataFrame, stretch: int = 60, repeated: float = 0.2, low: float = 0.25, heavy: int = 100_000) -> DataFrame:
    """(doc_id, score): the pages made for the most part of repeated keywords, links or tags; score is the part of the page's words
    that is filler, above MOSTLY.

    Null and blank texts, and texts without any word, are none. A doc_id delivered more than once is filler if any of
    its texts is. In a corpus in which no two pages share a pair of words only lists of links and tags are found. Further columns are
    ignored.
    """
    docs = documents.filter("doc_id is not null").filter(~blank("text")).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    docs = spread(docs).withColumn("page", F.xxhash64("text"))
    repeats = durable(docs.groupBy("page").agg(F.count("*").alias("copies")).filter("copies > 1"))
    few = repeats.count() <= SENT  # 16 bytes a row
    counted = docs.join(F.broadcast(repeats) if few else repeats, "page", "left").select("text", F.coalesce("copies", F.lit(1)).cast("double").alias("copies"))
    information = durable(pair_information(durable(page_counts(counted))))
    cut = lower_part(information, low)
    total = information.agg(F.sum("n")).head()[0] or 0
    most = F.lit(True) if information.count() <= SENT else F.col("n") * heavy >= total
    sent = information.filter(most).select("key", "npmi").toPandas().sort_values("key")  # at most `heavy` or SENT rows
    shared = documents.sparkSession.sparkContext.broadcast((sent["key"].to_numpy(np.int64), sent["npmi"].to_numpy(np.float64), bitmap(information.filter(~most))))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, held = shared.value
        for whole in it:
            for b in portions(whole, 1):
                owner, part, total, words, sure, asked, again, known, told, others, parts, offsets = judge_batch(b.column(1).to_pylist(), stretch, 0.0, keys, values, held)
                taken = pa.array(owner)
                left = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(others), pa.array(parts)], names=["key", "part"]))
                columns = [b.column(0).take(taken), b.column(2).take(taken), *(pa.array(c.astype(np.int32)) for c in (part, total, words, sure)), *map(pa.array, (asked, again, known, told)), left]
                made = pa.RecordBatch.from_arrays(columns, names=["doc_id", "page", "part", "total", "words", "sure", "asked", "again", "known", "told", "others"])
                yield made.filter(pa.array(undecided(owner, words, sure, asked, again, known, told, np.diff(offsets), repeated, cut)))

    of = ["doc_id", "page", "part"]
    judged = durable(docs.select("doc_id", "text", "page").mapInArrow(batches, STRETCH).dropDuplicates(of))
    once = ["total", "words", "sure", "asked", "again"]
    fixed = judged.select(*of, *once, "known", "told")
    others = judged.select(*of, F.explode("others").alias("_o")).select(*of, "_o.key", F.col("_o.part").alias("_part"))
    rest = others.join(information.filter(~most).select("key", "npmi"), "key").select(*of, *(F.lit(None).cast(fixed.schema[c].dataType).alias(c) for c in once), F.greatest("_part", F.lit(0.0)).alias("known"), (F.col("npmi") * F.col("_part")).alias("told"))
    whole = fixed.unionByName(rest).groupBy(*of).agg(*(F.max(c).alias(c) for c in once), F.sum("known").alias("known"), F.sum("told").alias("told"))
    repeats_itself = F.col("asked") & (F.col("again") >= repeated)
    hardly = F.col("asked") & ~repeats_itself
    of_kind = lambda kind, mark: [F.sum(F.when(kind, c)).alias(n + mark) for n, c in (("words", F.col("words")), ("_in", F.col("sure")), *((c, F.col(c) * F.col("words")) for c in ("again", "known", "told")))]
    pages = whole.groupBy("doc_id", "page").agg(F.max("total").alias("total"), F.sum("sure").alias("sure"), *of_kind(repeats_itself, ""), *of_kind(hardly, "_once"))
    enough = F.col("again") >= repeated * (1.5 * F.col("words") - 0.5 * F.col("known")) - ROUNDING * F.col("words")
    salad = (F.col("known_once") >= EVIDENCE) & (F.col("told_once") <= SALAD * cut * F.col("known_once"))
    more = F.when(enough & (F.col("told") <= cut * F.col("known")), F.col("words") - F.col("_in")).otherwise(0) + F.when(salad, F.col("words_once") - F.col("_in_once")).otherwise(0)
    of_page = pages.select("doc_id", ((F.col("sure") + more) / F.col("total")).alias("score")).filter(F.col("score") > MOSTLY)
    return of_page.groupBy("doc_id").agg(F.max("score").alias("score"))
