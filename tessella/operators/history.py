"""Conversation history as columns. A history is an array of structs (q, a), oldest first, in the row of its request, so all of
it is higher-order functions inside one stage, without any shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.common import strip
from tessella.functions.text import casefold

# Fixed value: the answer that stands for none.
NON_ANSWER = "I can't answer this"
# The headers and speakers of rendered histories, and the limits in characters.
QUESTION_HEADER, DIALOGUE_HEADER, USER, ASSISTANT = "CURRENT QUESTION\n", "\nPRIOR DIALOGUE\n", "user: ", "\nassistant: "
RETRIEVAL_LIMIT, ANSWER_LIMIT = 2400, 9000


def pairs(context: Column) -> Column:
    """The history without nulls: a null array is empty, a null question or answer is an empty string."""
    filled = F.transform(F.filter(context, lambda x: x.isNotNull()), lambda x: F.struct(F.coalesce(x["q"], F.lit("")).alias("q"), F.coalesce(x["a"], F.lit("")).alias("a")))
    return F.coalesce(filled, F.array().cast("array<struct<q:string,a:string>>"))


def answered(history: Column) -> Column:
    """The history without turns that were answered by NON_ANSWER."""
    return F.filter(history, lambda x: casefold(strip(x["a"])) != NON_ANSWER.casefold())


def newest_within(items: Column, budget: Column, cost: Callable[[Column], Column]) -> Column:
    """The longest run of newest items whose costs sum to at most the budget, in their order; no item is split or skipped."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(s: Column, x: Column) -> Column:
        used = s["used"] + cost(x)
        fits = s["open"] & (used <= budget)
        return F.struct(used.cast("long").alias("used"), F.when(fits, s["n"] + 1).otherwise(s["n"]).alias("n"), fits.alias("open"))

    n = F.aggregate(F.reverse(items), start, step, lambda s: s["n"])
    n = F.when(budget > 0, n).otherwise(0)
    return F.when(n > 0, F.slice(items, F.size(items) - n + 1, n)).otherwise(F.slice(items, 1, 0))


def rendered(x: Column) -> Column:
    return F.concat(F.lit(USER), x["q"], F.lit(ASSISTANT), x["a"])


def rewrite_history(history: Column, limit: int = RETRIEVAL_LIMIT) -> Column:
    lines = F.transform(history, rendered)
    return F.array_join(newest_within(lines, F.lit(limit), lambda x: F.length(x) + 1), "\n")


def retrieval_query(history: Column, question: Column, limit: int = RETRIEVAL_LIMIT) -> Column:
    """The question under its header and, as far as the limit allows, the newest turns under theirs."""
    current = F.concat(F.lit(QUESTION_HEADER), question)
    kept = newest_within(F.transform(history, rendered), F.greatest(F.lit(0), F.lit(limit) - F.length(current)), lambda x: F.length(x) + 1)
    return F.when(F.size(kept) > 0, F.concat(current, F.lit(DIALOGUE_HEADER), F.array_join(kept, "\n"))).otherwise(current)


def answer_history(history: Column, limit: int = ANSWER_LIMIT) -> Column:
    """Alternating messages (role, content) of the newest turns."""
    kept = newest_within(history, F.lit(limit), lambda x: F.length(x["q"]) + F.length(x["a"]))
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.flatten(F.transform(kept, lambda x: F.array(message("user", x["q"]), message("assistant", x["a"]))))
