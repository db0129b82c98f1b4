"""Sentence boundaries in any language and script.

Method: unsupervised statistics per language, by log-likelihood ratios, in the manner of Kiss and Strunk:

* sentence starters: words that stand at the start of a text or behind a question or exclamation mark far more often
  than their frequency explains;
* abbreviations: words before a full stop that is followed by what continues a sentence (a small letter, a number, a
  comma, a capitalised word that is no starter) more often than those are that follow the words that sentences of the language end with, by count;
* collocations: starters that follow a given abbreviation more often than they start sentences, and words that follow
  numbers with a full stop more often than they stand elsewhere (ordinals of dates).

Each full stop is then classified from the word before it, the word behind it and these statistics. The original
statistic for abbreviations compares a word's counts with and without a full stop; on manuals, where many words end
nearly every sentence they are in, it takes such words for abbreviations, so the context behind the full stop is
tested instead. Letters in one word with inner full stops and single letters count as abbreviations by their form.

Scripts that mark sentences otherwise: ideographic and Devanagari full stops end a sentence as they are; in Thai a
blank between two Thai letters does. Nothing ends inside quotation marks, and a line break alone ends nothing.

The counts are made over all records, each once, and stay in tables; the ratios are computed there. What is significant at
0.1 % after correction for the number of words tested in the language is kept, whatever its share of the corpus: a rare
language finds its abbreviations as a frequent one does. Only these words come to the driver, and no more than MOST.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat
from statistics import NormalDist

import pyarrow as pa
import regex
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.common import blank, durable
from tessella.llm.counts import key_counts
from tessella.llm.visual import LOOKALIKES

# Frequent function words that tell the languages of the Latin script apart.
FUNCTION_WORDS = {
    "en": "the of to and a in is that for on with as at by from or an be are this it every must",
    "de": "der die das und ist nicht ein eine den von mit auf im zu bei sie des wird dem bis",
    "fr": "le la les des et est un une du dans pour sur au par son ne pas se ce l d n",
    "es": "el la los las y que en un una por con se del al su para hasta lo según es más pero como este esta",
}
# Kinds of blocks that are one unit each.
WHOLE = ("heading", "table_row", "code")
# Quotation marks that open, with those that close.
QUOTES = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "‹": "›", "〈": "〉", "《": "》", "（": "）"}

_QUOTE = regex.compile("[\"" + "".join(a + b for a, b in QUOTES.items()) + "]")
_KNOWN = {w: [lang for lang, ws in FUNCTION_WORDS.items() if w in ws.split()] for ws in FUNCTION_WORDS.values() for w in ws.split()}
_HIDDEN = regex.compile(r"[\p{Cf}]+")
_WIDE = {c: c - 0xFEE0 for a, b in ((0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)) for c in range(a, b + 1)}
_LATIN = _WIDE | {ord(a): b for a, b in LOOKALIKES.items() if len(b) == 1}
_SCRIPTS = (("ru", r"\p{Cyrillic}"), ("ar", r"\p{Arabic}"), ("hi", r"\p{Devanagari}"), ("th", r"\p{Thai}"), ("ko", r"\p{Hangul}"), ("el", r"\p{Greek}"), ("zh", r"\p{Han}|\p{Hiragana}|\p{Katakana}"))
_SCRIPT = [(k, regex.compile(f"(?:{p})+")) for k, p in _SCRIPTS]
_FOREIGN = regex.compile("|".join(p for _, p in _SCRIPTS))
_ROMAN = regex.compile(r"\p{Latin}+")
_TO_MAP = regex.compile("[" + "".join(map(chr, _LATIN)) + "]")
_WORDS = regex.compile(r"[\p{L}\p{M}\p{N}--[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]]+", regex.V1)  # runs of words without blanks are none
_MARK = regex.compile(r"\.+|[!?؟。！？｡।॥۔…]+")
_NUMBER = regex.compile(r"\p{N}+(?:[.,:/-]\p{N}+)*")
_LABEL = regex.compile(r"\s*[-*•–]?\s*(?:(?i:step|schritt|étape|paso|шаг)\s+\p{N}+\s*[:.)]|[(\[]?\p{N}{1,3}[.)\]]|[(\[]?\p{L}[)\]]|\p{Ll}\.)\s+")
_CLOSERS = "\"'”’»)）」』】]›*_"
_WORD_AT = regex.compile(r"[\s\"'“„«‹(（\[¿¡*_]*([\p{L}\p{M}\p{N}_]+(?:['’.\-][\p{L}\p{M}\p{N}_]+)*)?")


def shape(word: str) -> str:
    return "#" if _NUMBER.fullmatch(word) else unicodedata.normalize("NFC", word).lower()


def cased(word: str) -> str:
    """The shape behind u (capitalised) or l, as starters and what follows a full stop are counted."""
    return ("u" if word[:1].isupper() else "l") + shape(word)


def _length(p: regex.Pattern, text: str) -> int:
    """Number of characters in the runs that a pattern finds."""
    return sum(map(len, p.findall(text)))


def readable(text: str) -> tuple[str, list[int] | None]:
    """The text as it is analysed, and the offset of each of its characters (None: the same). Invisible characters are left out;
    full-width letters and, in mostly Latin texts, look-alike letters are replaced one for one."""
    if text.isascii():
        return text, None
    at = None
    if _HIDDEN.search(text):
        at = [i for i, c in enumerate(text) if unicodedata.category(c) != "Cf"]
        text = "".join(text[i] for i in at)
    if not _TO_MAP.search(text):
        return text, at
    text = text.translate(_WIDE)
    roman = _length(_ROMAN, text)
    # letters of the alphabets that look-alikes come from stand below U+0590, those of other scripts above
    others = [c for c in text if c.isalpha() and c > "\u024f"]
    near = sum(c < "\u0590" for c in others)
    return (text.translate(_LATIN) if roman > near and roman >= len(others) - near else text), at


def languages(text: str) -> tuple[str, ...]:
    """The script's language; for the Latin script by function words, and every language that comes close: short and mixed texts
    are read with the abbreviations of all of them."""
    if not text.isascii() and _FOREIGN.search(text):
        n = {k: _length(p, text) for k, p in _SCRIPT}
        k = max(n, key=n.get)
        # CJK, Thai and the like in a text full of Latin names still are its language
        if n[k] * (3 if k in ("zh", "th", "hi", "ar") else 1) >= _length(_ROMAN, text):
            return (k,)
    votes = dict.fromkeys(FUNCTION_WORDS, 0)
    for w in text.lower().replace("'", " ").replace("’", " ").split():
        for k in _KNOWN.get(w, ()):
            votes[k] += 1
    most = max(votes.values())
    close = [k for k in sorted(votes, key=votes.get, reverse=True) if votes[k] and (votes[k] >= most - 1 or votes[k] >= 0.2 * most)]
    return tuple(close) or tuple(FUNCTION_WORDS)


def quoted(text: str) -> list[tuple[int, int]]:
    """Spans from an opening to its closing quotation mark; marks without a partner are no quotation."""
    out, stack = [], []
    straight = -1
    for m in _QUOTE.finditer(text):
        i, c = m.start(), m[0]
        if c == '"':
            if straight >= 0 and i > 0 and not text[i - 1].isspace():
                out.append((straight, i))
                straight = -1
            elif (i == 0 or not text[i - 1].isalnum()) and i + 1 < len(text) and not text[i + 1].isspace():
                straight = i
            continue
        if stack and c in stack[-1][1]:
            out.append((stack.pop()[0], i))
        elif c in QUOTES:
            stack.append((i, QUOTES[c]))
        else:
            for k in range(len(stack) - 2, -1, -1):
                if c in stack[k][1]:
                    out.append((stack[k][0], i))
                    del stack[k:]
                    break
    return out


@dataclass
class Model:
    """What was learned of each language. Starters hold cased shapes, the others plain ones; '#' is any number."""

    starters: dict[str, set[str]] = field(default_factory=lambda: defaultdict(set))
    abbreviations: dict[str, set[str]] = field(default_factory=lambda: defaultdict(set))
    collocations: dict[str, set[tuple[str, str]]] = field(default_factory=lambda: defaultdict(set))
    _of: dict[tuple[str, ...], tuple[set, set, set]] = field(default_factory=dict)



    def of(self, langs: tuple[str, ...]) -> tuple[set, set, set]:
        if langs not in self._of:
            self._of[langs] = tuple(set().union(*(x.get(k, ()) for k in langs)) for x in (self.starters, self.abbreviations, self.collocations))
        return self._of[langs]


def _marks(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, mark) of the terminal marks outside quotations; an ASCII full stop inside a word is none."""
    spans = quoted(text) if any(c in text for c in "\"“„«「『‹《（〈") else []
    inside = [False] * (len(text) + 1) if spans else None
    for a, b in spans:
        inside[a : b + 1] = [True] * (b + 1 - a)
    for m in _MARK.finditer(text):
        if inside and inside[m.start()]:
            continue
        yield m.start(), m.end(), m[0]


def _after(text: str, end: int) -> tuple[int, int, str]:
    """End of the closing marks behind a mark, start of what follows behind white space, and the word there."""
    k = end
    while k < len(text) and text[k] in _CLOSERS:
        if text[k] == '"' and k + 1 < len(text) and text[k + 1].isalnum():
            break
        k += 1
    j = k
    while j < len(text) and text[j].isspace():
        j += 1
    m = _WORD_AT.match(text, j)
    return k, j, m[1] or "" if m else ""


def _last_word(text: str, end: int) -> tuple[str, int]:
    """The word that ends at `end` and its start; its characters are letters, marks, digits and inner joints."""
    i = end
    while i > 0 and (text[i - 1].isalnum() or text[i - 1] == "_" or unicodedata.combining(text[i - 1]) or text[i - 1] in ".-'’/@:&+" and i - 1 > 0 and (text[i - 2].isalnum() or text[i - 2] == ".") and i < end):
        i -= 1
    return text[i:end], i


def _update(counter: Counter, rows: list) -> None:
    for kind, text in rows:
        if text is None or kind in WHOLE:
            continue
        text, _ = readable(text)
        lang = languages(text)[0]
        start = _LABEL.match(text)
        first = _WORD_AT.match(text, start.end() if start else 0)
        counter.update(zip(repeat(lang), _WORDS.findall(text)))
        if first and first[1] and _WORDS.match(first[1]):
            counter[f"S\t{lang}\t{cased(first[1])}"] += 1
        for a, e, mark in _marks(text):
            k, j, nxt = _after(text, e)
            if j >= len(text) or mark[0] == "…" or mark.startswith(".."):
                continue
            if mark[0] != ".":
                if nxt and _WORDS.match(nxt):
                    counter[f"S\t{lang}\t{cased(nxt)}"] += 1
                continue
            if j == k and text[j] not in ",;:":
                continue  # no blank behind it
            before, _ = _last_word(text, a)
            if before:
                then = "," if not nxt or text[j] in ",;:" else cased(nxt)
                counter[f"A\t{lang}\t{shape(before)}\t{then}"] += 1


def _spell(key: str | tuple[str, str]) -> str:
    return key if isinstance(key, str) else f"T\t{key[0]}\t{cased(key[1])}"


def likelihood_ratio(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Dunning's statistic for two binomial samples, 0 where one of them is empty."""

    def term(k: Column, n: Column, p: Column) -> Column:
        return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(n > k, (n - k) * F.log(1 - p)).otherwise(0.0)

    p = (k1 + k2) / F.greatest(F.lit(1.0), n1 + n2)
    p1, p2 = k1 / F.greatest(F.lit(1.0), n1), k2 / F.greatest(F.lit(1.0), n2)
    return F.when((n1 > 0) & (n2 > 0) & (p > 0) & (p < 1), 2 * (term(k1, n1, p1) + term(k2, n2, p2) - term(k1, n1, p) - term(k2, n2, p))).otherwise(0.0)


def significant(tests: int, level: float = 0.001) -> float:
    """The chi-square value (one degree of freedom) beyond which one of so many tests is significant."""
    return NormalDist().inv_cdf(1 - level / max(1, tests) / 2) ** 2


#: Words and collocations that a model may hold (some 100 bytes each).
MOST = 2_000_000


def learn(records: DataFrame) -> Model:
    """records: kind, text; each counts once."""
    counts = key_counts(records.select("kind", "text"), _update, _spell)
    parts = F.split("key", "\t")
    counts = durable(counts.select(parts[0].alias("kind"), parts[1].alias("lang"), parts[2].alias("w"), F.get(parts, F.lit(3)).alias("x"), F.col("n").cast("double").alias("n")))
    sums = counts.groupBy("lang").agg(*(F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0.0)).alias(f"all_{k}") for k in "TSA"), F.count_if(F.col("kind") == "S").alias("tests_S"), F.count_distinct(F.when(F.col("kind") == "A", F.col("w"))).alias("tests_A"), F.count_if(F.col("kind") == "A").alias("tests_C"))
    rows = sums.collect()  # one a language of languages()
    limits = {k: F.coalesce(F.element_at(F.create_map(*[x for r in rows for x in (F.lit(r["lang"]), F.lit(significant(r["tests_" + k])))]), F.col("lang")), F.lit(0.0)) for k in "SAC"} if rows else dict.fromkeys("SAC", F.lit(0.0))
    of = F.broadcast(sums.select("lang", "all_T", "all_S"))  # one row a language

    words = counts.filter("kind = 'T'").select("lang", F.col("w").alias("x"), F.col("n").alias("t"))
    starts = counts.filter("kind = 'S'").select("lang", F.col("w").alias("x"), F.col("n").alias("s"))
    begun = starts.join(words, ["lang", "x"], "left").join(of, "lang").withColumn("t", F.greatest("s", F.coalesce("t", F.lit(0.0))))
    often = F.col("s") / F.col("all_S") > F.col("t") / F.greatest("t", "all_T")
    starters = begun.filter(often & (likelihood_ratio(F.col("s"), F.col("all_S"), F.col("t") - F.col("s"), F.greatest(F.lit(1.0), F.col("all_T") - F.col("all_S"))) > limits["S"])).select("lang", "x", F.lit(True).alias("starter"))

    behind = durable(counts.filter("kind = 'A'").select("lang", "w", "x", "n").join(starters, ["lang", "x"], "left").join(starts, ["lang", "x"], "left").join(words, ["lang", "x"], "left"))
    goes_on = (F.col("x") == ",") | (F.substring("x", 2, 100) == "#") | F.col("starter").isNull()
    stops = behind.groupBy("lang", "w").agg(F.sum("n").alias("n"), F.sum(F.when(goes_on, F.col("n")).otherwise(0.0)).alias("more"))
    overall = F.broadcast(stops.groupBy("lang").agg((F.sum("more") / F.sum("n")).alias("rate")))  # one row a language, as below
    plain = stops.join(overall, "lang").filter("more <= rate * n")  # words that sentences end with
    rates = F.broadcast(plain.groupBy("lang").agg(F.sum("n").alias("all_n"), F.sum("more").alias("all_more")))
    n, more, rest_n, rest_more = (F.col(c) for c in ("n", "more", "all_n", "all_more"))
    found = (more >= 5) & (more * rest_n > 2 * rest_more * n) & (more > 0.1 * n) & (likelihood_ratio(more, n, rest_more, rest_n) > limits["A"])
    short = stops.filter("w <> '#'").join(rates, "lang").filter(found).select("lang", "w", F.col("n").alias("of"))

    s = F.coalesce(F.col("s"), F.lit(0.0))
    after = behind.filter("starter and substring(x, 1, 1) = 'u'").join(short, ["lang", "w"]).join(of, "lang")
    after = after.filter((n / F.col("of") > 5 * s / F.greatest(F.lit(1.0), F.col("all_S"))) & (likelihood_ratio(n, F.col("of"), s, F.greatest(F.lit(1.0), F.col("all_S"))) > limits["C"]))
    dates = behind.filter("w = '#' and substring(x, 1, 1) = 'u' and starter is null").filter(n >= 0.5 * F.greatest(n, F.coalesce(F.col("t"), F.lit(0.0)))).select("lang", "w", "x")
    kept = starters.select(F.lit("S").alias("kind"), "lang", F.lit("").alias("w"), "x").unionByName(short.select(F.lit("A").alias("kind"), "lang", "w", F.lit("").alias("x")))
    kept = durable(kept.unionByName(after.select(F.lit("C").alias("kind"), "lang", "w", F.expr("substring(x, 2)").alias("x"))).unionByName(dates.select(F.lit("C").alias("kind"), "lang", "w", F.expr("substring(x, 2)").alias("x"))))
    if (size := kept.count()) > MOST:
        raise ValueError(f"{size} significant words are more than a worker is given")
    model = Model()
    for kind, lang, w, x in kept.collect():
        if kind == "S":
            model.starters[lang].add(x)
        elif kind == "A":
            model.abbreviations[lang].add(w)
        else:
            model.collocations[lang].add((w, x))
    return model


def _by_form(word: str) -> bool:
    """A single letter, or single letters joined by full stops or blanks in between (e.g., p.m, z)."""
    return len(word) == 1 and word.isalpha() or "." in word and all(len(x) <= 2 and x.isalpha() for x in word.replace("-", ".").split(".") if x)


def boundaries(text: str, langs: tuple[str, ...], model: Model) -> list[int]:
    """Offsets behind which a new sentence begins (white space not skipped), in a text as readable() gives it."""
    cuts: list[int] = []
    begin = 0
    label = _LABEL.match(text)
    skip = label.end() if label else 0
    lang = langs[0]
    starters, abbreviations, collocations = model.of(langs)
    for a, e, mark in _marks(text):
        if e <= skip:
            continue
        k, j, nxt = _after(text, e)
        if j >= len(text):
            break
        c = mark[0]
        blank_behind = j > k
        upper = bool(nxt) and (nxt[0].isupper() or nxt[0].isnumeric() or not nxt[0].islower() and nxt[0].isalpha())
        known = bool(nxt) and cased(nxt) in starters
        if c in "。！？｡।॥۔؟" or c in "!?" and (lang == "zh"):
            # such marks need no blank; a closing mark behind them belongs to the sentence
            end = k > e and bool(nxt) and nxt[0].islower()
            cut = not end
        elif c == "…" or mark.startswith(".."):
            cut = blank_behind and (known or lang in ("ru", "ar") and upper) and nxt[0].isupper() if nxt else False
        elif c in "!?":
            cut = blank_behind and (not nxt or upper or known or k == e)
        else:
            before, at = _last_word(text, a)
            s = shape(before)
            if not blank_behind:
                # a missing blank: a capitalised word in small letters behind a word or number
                glued = k == e and len(nxt) > 1 and nxt[0].isupper() and (nxt[1].islower() or known) and len(before) > 1 and not ("." in before and not _NUMBER.fullmatch(before))
                cut = glued and (s not in abbreviations or known)
            elif text[j] in ",;:)":
                cut = False
            elif not before:
                cut = k > e and upper  # ").": a bracket before the full stop
                cut = cut or bool(upper or known)
            elif s == "#":
                first = not text[begin:at].strip(" \t\r\n\f\v -*•–([（　\xa0")
                cut = not (first and len(before) <= 3) and (known or bool(nxt) and not nxt[0].islower() or not nxt) and ("#", shape(nxt) if nxt else "") not in collocations
            elif s in abbreviations or _by_form(before):
                first = at == begin + len(text[begin:at]) - len(text[begin:at].lstrip()) and len(before) == 1 and not text[begin:at].strip()
                cut = not first and known and upper and not (nxt and nxt[0].isnumeric()) and (s, shape(nxt)) not in collocations
            else:
                cut = True
                if k > e and bool(nxt) and nxt[0].islower() and not known:
                    cut = False  # a quotation or bracket that ends inside the sentence
        if cut:
            cuts.append(k)
            begin = k
    if lang == "th":
        cuts = sorted({*cuts, *(m.start() for m in _THAI.finditer(text))})
    return cuts


_THAI = regex.compile(r"(?<=\p{Thai})\s+(?=\p{Thai})")


def sentence_spans(text: str | None, kind: str | None, model: Model) -> list[tuple[int, int]]:
    """Half-open code point offsets of a text's sentences, without outer white space. Headings, table rows and code are one unit
    each. Null and blank texts have none."""
    if text is None or not text.strip():
        return []
    if kind in WHOLE:
        cuts: list[int] = []
    else:
        seen, at = readable(text)
        cuts = boundaries(seen, languages(seen), model)
        if at is not None:
            cuts = [at[c] if c < len(at) else len(text) for c in cuts]
    out, begin = [], 0
    for end in (*cuts, len(text)):
        piece = text[begin:end]
        stripped = piece.strip()
        if stripped:
            a = begin + len(piece) - len(piece.lstrip())
            if out and not any(c.isalpha() for c in stripped):
                out[-1] = (out[-1][0], a + len(stripped))  # a footnote's number is no sentence
            else:
                out.append((a, a + len(stripped)))
        begin = end
    return out


def sentence_units(records: DataFrame) -> DataFrame:
    """(record_id, start_char, end_char): one row per sentence of every record (record_id, kind, text and, where ids of several tables
    may be the same, source).

    Offsets are half-open code points of the record's own text. Rows of a repeated record_id (of one source) count once, for the statistics
    as well; null ids and null or blank texts give no row; a null kind is running text; further columns are ignored.
    """
    key = ["source", "record_id"] if "source" in records.columns else ["record_id"]
    rows = records.filter("record_id is not null").filter(~blank("text")).select(*key, "kind", "text").dropDuplicates(key).persist(StorageLevel.DISK_ONLY)  # both scans read what is shuffled once
    shared = records.sparkSession.sparkContext.broadcast(learn(rows))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in it:
            ids, starts, ends = [], [], []
            for record, kind, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for a, e in sentence_spans(text, kind, model):
                    ids.append(record)
                    starts.append(a)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["record_id", "start_char", "end_char"])

    return rows.select("record_id", "kind", "text").mapInArrow(batches, "record_id string, start_char int, end_char int")


def block_and_unit_records(blocks: DataFrame, units: DataFrame) -> DataFrame:
    """The records of sentence_units: blocks by block_id and source units by source_unit_id."""
    of_blocks = blocks.select(F.lit("block").alias("source"), F.col("block_id").alias("record_id"), "kind", "text")
    return of_blocks.unionByName(units.select(F.lit("unit").alias("source"), F.col("source_unit_id").alias("record_id"), "kind", "text"))
