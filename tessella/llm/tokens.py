"""The search tokenizer's token count, in the JVM and in Python.

Token: a maximal run of letters, digits (Unicode L, N) and underscores; a run that holds a Han ideograph counts one
token per character; every other character that is not white space is one token.
"""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.common import WHITE

# The blocks of Han ideographs.
HAN_BLOCKS = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAD9), (0x20000, 0x323AF))
_HAN_JAVA = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in HAN_BLOCKS) + "]"
_HAN = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in HAN_BLOCKS) + "]")
_TOKEN = regex.compile(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f]")


def token_count(c: Column) -> Column:
    """Number of tokens of a string column, without Python; null for null."""
    runs = F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    of_runs = F.aggregate(runs, F.lit(0), lambda n, r: n + F.when(r.rlike(_HAN_JAVA), F.length(r)).otherwise(1))
    others = F.length(F.regexp_replace(c, rf"(?U)[\p{{L}}\p{{N}}_]+|{WHITE}+", ""))
    return of_runs + others


def token_spans(text: str) -> list[tuple[int, int]]:
    """Half-open code point offsets of the tokens."""
    spans: list[tuple[int, int]] = []
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        if b - a > 1 and _HAN.search(text, a, b):
            spans.extend((i, i + 1) for i in range(a, b))
        else:
            spans.append((a, b))
    return spans
