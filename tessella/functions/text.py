"""Text functions as column expressions; only what the JVM has no function for runs in Arrow-batched Python."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.common import WHITE, strip

# Unicode white space, spelt out so that every regular expression engine agrees.
BLANKS = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Word characters whose Unicode name holds CJK.
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FA6D}\x{FA70}-\x{FAD9}\x{20000}-\x{323AF}]"
TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{BLANKS}]"
# References to what was said before, in English (whole words) and Chinese (anywhere).
BACK_REFERENCES = ("it|its|this|that|these|those|they|them", "the previous|the earlier|the above|mentioned|same|next step", "after that|before that|what about|how about", "which one")
BACK_REFERENCES_ZH = "它|這個|那個|這些|那些|前面|剛才|之前|上述|同樣|下一步|接著|然後|之後"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: a lambda's variable is not copied into every place that names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def casefold(c: Column) -> Column:
    """Lower case, with the two letters of common use whose full case folding differs from it."""
    return F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def tokenize(c: Column | str) -> Column:
    """Search tokens in order: runs of word characters and single marks, case folded; a run that holds a CJK character is taken
    character by character. Null gives an empty array."""
    col = F.col(c) if isinstance(c, str) else c
    parts = F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.flatten(F.transform(parts, lambda t: F.when(t.rlike(CJK), F.transform(F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0)), casefold)).otherwise(F.array(casefold(t)))))


# The labels of the lexical projection and of the encoder's input.
TITLE_LABEL, FILE_LABEL, PATH_LABEL, PASSAGE_LABEL = "document title: ", "\nfilename: ", "\nsection path: ", "passage: "


def retrieval_text(title: Column, filename: Column, path: Column, text: Column) -> Column:
    """What lexical search indexes of a passage: title, filename and section path on lines of their own, then the text."""
    empty = F.lit("")
    return F.concat(F.lit(TITLE_LABEL), F.coalesce(title, empty), F.lit(FILE_LABEL), F.coalesce(filename, empty), F.lit(PATH_LABEL), F.coalesce(F.array_join(path, " > "), empty), F.lit("\n"), F.coalesce(text, empty))


def embedding_text(path: Column, text: Column) -> Column:
    return F.concat(F.lit(PASSAGE_LABEL), F.coalesce(F.array_join(path, " > "), F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))


def indexed_text(retrieval: Column, text: Column) -> Column:
    """The lexical projection, or the text where that is null or empty."""
    return F.coalesce(F.nullif(retrieval, F.lit("")), text)


def _json(c: Column, kind: str) -> Column:
    """A value as compact JSON. Strings are escaped by to_json; control characters are spelt in small letters."""
    if kind == "string":
        quoted = F.to_json(F.array(c))
        return F.coalesce(F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit("null"))
    return F.coalesce(c.cast("string"), F.lit("null"))


def stable_id(prefix: str, *parts: tuple[Column, str]) -> Column:
    """prefix_ and 24 hex digits of the SHA-256 of the parts as a compact JSON array. parts: (column, "string" or "number")."""
    payload = F.concat(F.lit("["), F.concat_ws(",", *(_json(c, k) for c, k in parts)), F.lit("]"))
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(payload, 256), 1, 24))


def has_back_reference(c: Column) -> Column:
    """Whether a question refers to an earlier turn. Null is no reference."""
    words = "|".join(BACK_REFERENCES)
    return F.coalesce(c.rlike(rf"(?i)(^|[^\p{{L}}\p{{N}}_])({words})($|[^\p{{L}}\p{{N}}_])") | c.rlike(BACK_REFERENCES_ZH), F.lit(False))


def _without_end(c: Column, end: Column) -> Column:
    return strip(F.left(c, F.length(c) - F.length(end)))


def continuation_parts(title: Column) -> Column:
    """struct(base, part, total) of a heading like "Title (2/3)", with or without either bracket; null for any other. Read from the end:
    a bracket, the total, a slash, the part, a bracket."""
    t = strip(title)
    t = F.when(t.endswith(")"), _without_end(t, F.lit(")"))).otherwise(t)
    digits = lambda c: F.regexp_extract(c, "[0-9]+$", 0)

    def parts(t: Column) -> Column:
        return let(F.struct(digits(t).alias("total"), _without_end(t, digits(t)).alias("left")), lambda a: F.when((a["total"] != "") & a["left"].endswith("/"), numbered(a["total"], _without_end(a["left"], F.lit("/")))))

    def numbered(total: Column, left: Column) -> Column:
        return let(F.struct(digits(left).alias("part"), _without_end(left, digits(left)).alias("base")), lambda b: F.struct(strip(F.when(b["base"].endswith("("), F.left(b["base"], F.length(b["base"]) - 1)).otherwise(b["base"])).alias("base"), b["part"].try_cast("int").alias("part"), total.try_cast("int").alias("total")))

    found = let(t, parts)
    return let(found, lambda f: F.when((f["base"] != "") & (f["part"] >= 1) & (f["part"] <= f["total"]), f))


def llm_object(content: Column) -> Column:
    """The JSON text of a model's reply without its code fence (three backticks, perhaps the word json, and three backticks at its end); null
    unless it is one object."""
    body = strip(content)
    inside = F.substring(body, F.lit(4), F.length(body))
    inside = F.when(F.lower(F.left(inside, F.lit(4))) == "json", F.substring(inside, F.lit(5), F.length(inside))).otherwise(inside)
    inside = F.when(inside.endswith("```"), F.left(inside, F.length(inside) - 3)).otherwise(inside)
    bare = F.when(body.startswith("```"), strip(inside)).otherwise(body)
    return F.when(F.try_parse_json(bare).isNotNull() & bare.startswith("{"), bare)


# Abbreviations behind which a full stop ends no conservative sentence; a single capital letter is one as well.
ABBREVIATIONS = ("Mr", "Mrs", "Dr", "vs", "Fig", "No", "e.g", "i.e")
#: Marks the ends; a noncharacter, which no text holds.
_SEAM = "\uffff"


def sentences_of(c: Column) -> Column:
    """array<struct<start_char, end_char>> of the conservative sentences, without outer white space; empty for null and blank text.

    A sentence ends behind an ideographic mark, and behind a full stop, exclamation or question mark with its closing marks if blanks and
    then a capital letter, digit or ideograph follow. All of it runs in the JVM: full stops of abbreviations are masked, the text is split behind
    every mark, and a part joins the one before it unless it may begin a sentence. Only lengths count, so masks need not be undone.
    """
    short = "|".join(x.replace(".", r"\.") for x in ABBREVIATIONS)
    masked = F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?U)(?<!\w)({short}|[A-Z])\.", "$1\ufffe")
    parts = F.split(F.regexp_replace(masked, r"(?U)(?:[.!?][\"')\]]*\s+|[。！？])", "$0" + _SEAM), _SEAM)
    none = F.array().cast("array<struct<start_char:int,end_char:int>>")

    def step(s: Column, part: Column) -> Column:
        lead = F.length(part) - F.length(F.regexp_replace(part, rf"(?U)^{WHITE}+", ""))
        body = strip(part)
        start, end = s["at"] + lead, s["at"] + lead + F.length(body)
        begins = s["closed"] | body.rlike("^[A-Z0-9\u4e00-\u9fff]") | (F.size(s["out"]) == 0)
        before = F.element_at(s["out"], F.when(F.size(s["out"]) > 0, F.lit(-1)))
        span = F.struct(F.when(begins, start).otherwise(before["start_char"]).alias("start_char"), end.alias("end_char"))
        kept = F.when(begins, s["out"]).otherwise(F.slice(s["out"], F.lit(1), F.greatest(F.lit(0), F.size(s["out"]) - 1)))
        out = F.when(body != "", F.concat(kept, F.array(span))).otherwise(s["out"])
        closed = F.when(body != "", body.rlike("[。！？]$")).otherwise(s["closed"])
        return F.struct((s["at"] + F.length(part)).alias("at"), closed.alias("closed"), out.alias("out"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit(False).alias("closed"), none.alias("out")), step, lambda s: s["out"])


def coverage_form(text: str | None, canonical: bool) -> str | None:
    """NFKC without any white space; with `canonical`, the separator of table cells counts as a blank."""
    if text is None:
        return None
    t = unicodedata.normalize("NFKC", text)
    return "".join((t.replace(" | ", " ") if canonical else t).split())


def _vectorised(f: Callable, returns: T.DataType) -> Callable[[Column], Column]:
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action=None)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, returns)


def coverage_text(c: Column, canonical: bool = False) -> Column:
    return _vectorised(lambda t: coverage_form(t if isinstance(t, str) else None, canonical), T.StringType())(c)
