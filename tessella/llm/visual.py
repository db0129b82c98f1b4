"""One form for all text that looks the same.

Method: texts are exploded to positioned code points; each code point is looked up in a mapping table (compatibility
and canonical decomposition, look-alike letters, kinds of blank and hyphen, invisible characters); combining marks
are put in the order of their class; marks are recomposed with their base; strings are rebuilt in order of position.

The steps run on the code points of a whole Arrow batch at once: the exploded table is a pair of arrays
(position's row, code point), the broadcast lookup is a gather by code point, the ordering is one stable sort and
recomposition is a gather by pair. The relational form of the same plan makes a row of every character and has to
sort and group them again, which moves some 20 bytes per character through a shuffle; here nothing is shuffled.
Texts in pure ASCII map to themselves and are passed through.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.common import blank, durable

# Letters of other scripts that look like a Latin letter, with that letter.
LOOKALIKES = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ԍ": "G",
    "а": "a", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ѕ": "s", "х": "x", "у": "y", "ԛ": "q", "ԝ": "w", "ԁ": "d", "ѵ": "v", "Ӏ": "I", "ӏ": "l", "ү": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ο": "o", "ν": "v", "ι": "ı", "ϲ": "c", "ϳ": "j", "α": "a", "ρ": "p",
    "ɑ": "a", "ɡ": "g", "ɩ": "ı", "ʋ": "v", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲏ": "H", "Ⲙ": "M", "Ⲛ": "N", "Ⲧ": "T", "Ⲕ": "K", "Ⲉ": "E",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "ք": "f", "Տ": "S", "Օ": "O", "Լ": "L",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮢ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
}
# Characters that look like a plain hyphen-minus.
HYPHENS = "‐‑﹣－"
# Characters without any visible form (ranges).
INVISIBLE = ((0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF))
# Blocks whose <compat> decompositions only join letters or repeat an ideograph, so both look the same.
JOINED = ((0x0132, 0x0133), (0x01C7, 0x01CC), (0x01F1, 0x01F3), (0x2E80, 0x2FDF), (0xFB00, 0xFB17), (0x0587, 0x0587), (0x0675, 0x0678), (0x0EDC, 0x0EDD), (0x2160, 0x217F))
# Kinds of decomposition that change width, joining or line breaking, but not what is read.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>", "<vertical>", "<small>")


def _expand(ch: str) -> str:
    """What a single character reads as, decomposed."""
    cp = ord(ch)
    if any(a <= cp <= b for a, b in INVISIBLE):
        return ""
    if ch in HYPHENS:
        return "-"
    if ch not in "\n\r\v\f\x85  " and (ch == "\t" or unicodedata.category(ch) == "Zs"):
        return " "
    if cp in (0x2028, 0x2029, 0x85):
        return "\n"
    if ch in LOOKALIKES:
        return unicodedata.normalize("NFD", LOOKALIKES[ch])
    kind, _, parts = unicodedata.decomposition(ch).rpartition("> ")
    if not parts:
        return "".join(map(_expand, unicodedata.normalize("NFD", ch))) if 0xAC00 <= cp <= 0xD7A3 else ch
    if kind and not (kind + ">" in SAME_LOOK or kind == "<compat" and any(a <= cp <= b for a, b in JOINED)):
        return ch
    return "".join(_expand(chr(int(x, 16))) for x in parts.split())


class _Tables:
    """Lookup tables over all code points, built once per worker from the rules above and the Unicode database."""

    def __init__(self) -> None:
        top = 0x110000
        self.first = np.arange(top, dtype=np.uint32)
        self.count = np.ones(top, dtype=np.uint8)
        self.mark = np.zeros(top, dtype=np.uint8)
        self.more: dict[int, np.ndarray] = {}
        pairs: dict[tuple[int, int], int] = {}
        for cp in (*range(0x80, 0x32FFF), *range(0xE0000, 0xE1000), 9):
            if 0xD800 <= cp <= 0xDFFF or 0x3400 <= cp <= 0x4DBF or 0x4E00 <= cp <= 0x9FFF:
                continue
            ch = chr(cp)
            self.mark[cp] = unicodedata.combining(ch)
            out = _expand(ch)
            if out != ch:
                self.count[cp] = len(out)
                self.first[cp] = ord(out[0]) if out else 0
                if len(out) > 1:
                    self.more[cp] = np.array([ord(x) for x in out], dtype=np.uint32)
            parts = unicodedata.decomposition(ch)
            if parts and parts[0] != "<" and " " in parts and unicodedata.normalize("NFC", ch) == ch:
                a, b = (int(x, 16) for x in parts.split())
                pairs[a, b] = cp
        for cp in range(0xAC00, 0xD7A4):  # Hangul syllables, by rule
            s = unicodedata.normalize("NFD", chr(cp))
            pairs[(ord(s[0]), ord(s[1])) if len(s) == 2 else (ord(unicodedata.normalize("NFC", s[:2])), ord(s[2]))] = cp
        self.pairs = {a << 32 | b: c for (a, b), c in pairs.items()}
        self.second = np.zeros(top, dtype=bool)
        self.second[[b for _, b in pairs]] = True


@lru_cache(maxsize=1)
def _tables() -> _Tables:
    return _Tables()


def _canonical(points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """points and rows: the exploded table in order of row and position; returns it in the consistent form."""
    t = _tables()
    # decomposition and look-alikes: a gather, repeated as often as the mapping has code points
    n = t.count[points]
    wide = np.flatnonzero(n > 1)
    at = np.cumsum(n, dtype=np.int64) - n
    out = np.repeat(t.first[points], n)
    for i in wide:
        m = t.more[int(points[i])]
        out[at[i] : at[i] + len(m)] = m
    rows = np.repeat(rows, n)
    # combining marks by class: a stable sort inside each base's run of marks
    cls = t.mark[out]
    marks = np.flatnonzero(cls)
    if len(marks):
        run = np.cumsum((cls == 0) | np.r_[True, rows[1:] != rows[:-1]])
        order = marks[np.lexsort((marks, cls[marks], run[marks]))]
        out[marks], cls = out[order], cls.copy()
        cls[marks] = t.mark[out[marks]]
    # recomposition: only the neighbourhood of characters that can be second in a pair is touched
    seconds = np.flatnonzero(t.second[out])
    if len(seconds):
        keep = np.ones(len(out), dtype=bool)
        base, last = -1, -1
        for i in map(int, seconds):
            if i == 0 or rows[i - 1] != rows[i]:
                continue
            j = i - 1
            while j >= 0 and rows[j] == rows[i] and (not keep[j] or cls[j] and (not cls[i] or cls[j] < cls[i])):
                j -= 1
            if j < 0 or rows[j] != rows[i] or cls[j] and cls[i]:
                continue  # no base, or a mark of the same class stands between
            if not cls[i] and any(keep[j + 1 : i]):
                continue  # a vowel or final consonant joins only its direct neighbour
            joined = t.pairs.get(int(out[j]) << 32 | int(out[i]))
            if joined is not None:
                out[j], keep[i] = joined, False
        out, rows = out[keep], rows[keep]
    return out, rows


def canonical_texts(texts: pa.Array) -> pa.Array:
    """The consistent form of each text of an Arrow array; null stays null."""
    texts = texts.cast(pa.string())
    plain = texts.to_pylist()
    todo = [i for i, x in enumerate(plain) if x and not (x.isascii() and "\t" not in x)]
    if todo:
        joined = "".join(plain[i] for i in todo)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.array([len(plain[i]) for i in todo])
        out, rows = _canonical(points, np.repeat(np.arange(len(todo)), lengths))
        ends = np.searchsorted(rows, np.arange(len(todo)), side="right")
        text = out.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        begin = 0
        for i, end in zip(todo, ends, strict=True):
            plain[i], begin = text[begin:end], end
    return pa.array(plain, pa.string())


def canonical(df: DataFrame, column: str, to: str = "canonical_text") -> DataFrame:
    """`df` with the consistent form of `column` in `to`. Null stays null and empty stays empty; texts of any length are
    treated whole. A column that is called as `to` already is replaced; other columns are kept."""
    kept = df.drop(to) if to != column else df
    schema = T.StructType([f for f in kept.schema.fields if f.name != to] + [T.StructField(to, T.StringType())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            new = canonical_texts(b.column(b.schema.get_field_index(column)))
            kept_columns = [(n, b.column(i)) for i, n in enumerate(b.schema.names) if n != to]
            yield pa.RecordBatch.from_arrays([c for _, c in kept_columns] + [new], names=[n for n, _ in kept_columns] + [to])

    return kept.mapInArrow(batches, schema)


def same_look(records: DataFrame) -> DataFrame:
    """Records of all kinds with the class of texts they read as.

    records: kind, id, text. Returns kind, id, text_key (a hash of the raw text), class_key (a hash of the
    consistent form). Rows of a repeated (kind, id) count once; null ids and blank texts (also such as hold only invisible
    characters) are left out. Keys are 128-bit hashes, so that only 16 bytes a row are shuffled, not the texts.
    """
    form = canonical(records.filter("id is not null").filter(~blank("text")).select("kind", "id", "text"), "text", "form")
    form = form.filter(~blank("form"))
    keyed = form.select("kind", "id", F.unhex(F.md5("text")).alias("text_key"), F.unhex(F.md5("form")).alias("class_key"))
    return keyed.groupBy("kind", "id").agg(F.min(F.struct("text_key", "class_key")).alias("_k")).select("kind", "id", "_k.*")


def look_texts(keyed: DataFrame) -> DataFrame:
    """(kind, class_key, text_key, copies, texts) of same_look(): every distinct text with the number of its copies and that of the
    distinct texts that read the same, itself included. Copies are added up on the map side, so a hot text is one row a task."""
    texts = keyed.groupBy("kind", "class_key", "text_key").agg(F.count("*").alias("copies"))
    return texts.join(texts.groupBy("kind", "class_key").agg(F.count("*").alias("texts")), ["kind", "class_key"])


#: Copies of a text that one row of the pair join stands for.
SHARE = 4096


def look_pairs(records: DataFrame) -> DataFrame:
    """(left_id, right_id): pairs of one kind whose texts differ in code points but read the same; the smaller id first.

    This is a view of the classes: links are made between distinct texts of a class, by the texts' rows alone, and each link
    is then written out over the copies of both texts. A text without a twin leaves before that, pairs of exact copies never
    arise, and the copies of a hot text are joined in shares of SHARE, each by itself.
    """
    keyed = durable(same_look(records))
    texts = durable(look_texts(keyed).filter("texts > 1").withColumn("shares", F.ceil(F.col("copies") / SHARE).cast("int")))
    other = texts.select("kind", "class_key", F.col("text_key").alias("right_text"))
    links = texts.select("kind", "class_key", F.col("text_key").alias("left_text"), "shares").join(other, ["kind", "class_key"]).filter("left_text < right_text")
    links = links.select("kind", "left_text", "right_text", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    members = keyed.drop("class_key").join(texts.select("kind", "text_key", "shares"), ["kind", "text_key"])
    left = members.select("kind", F.col("text_key").alias("left_text"), F.col("id").alias("_a"), F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("share"))
    right = members.select("kind", F.col("text_key").alias("right_text"), F.col("id").alias("_b"))
    pairs = links.join(left, ["kind", "left_text", "share"]).join(right, ["kind", "right_text"])
    return pairs.select(F.least("_a", "_b").alias("left_id"), F.greatest("_a", "_b").alias("right_id"))


def block_and_request_records(blocks: DataFrame, requests: DataFrame) -> DataFrame:
    """The records of look_pairs: blocks by text and requests by question."""
    b = blocks.select(F.lit("block").alias("kind"), F.col("block_id").alias("id"), "text")
    return b.unionByName(requests.select(F.lit("request").alias("kind"), F.col("request_id").alias("id"), F.col("question").alias("text")))
