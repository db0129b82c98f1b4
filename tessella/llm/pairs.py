"""Defects of prompt and response pairs.

Three models are trained here:

* Language: naive Bayes on character n-grams. It is fitted on a bounded sample of documents with a language label
  (`per_language` documents a language, chosen by a hash of doc_id), with all its n-grams; labels are noisy, which naive
  Bayes averages out. The posteriors of prompt and response are compared.
* End of text: n-gram likelihood that a sentence ends after its last words, backed off from three words to one. It is
  counted over all responses, at every word of every sentence that is closed by a full stop, and every context that
  occurs twice is kept, in a table. Contexts that make up at least 1/`heavy` of all, which are at most `heavy` rows whatever
  the log, are sent to the workers; responses whose last words hold another one are joined with the table.

* Refusal: logistic regression on word n-grams, fitted on labelled sentences and a bounded sample of the log (refusals.py).

The first defect that applies is reported: empty, copy, refusal, language, truncated.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.common import durable, latest
from tessella.llm.counts import key_counts
from tessella.llm.refusals import declines, refusal_model

# Texts that stand for no answer (compared without case and outer brackets).
PLACEHOLDERS = {"n/a", "na", "n.a", "none", "null", "nil", "nan", "tbd", "todo", "empty", "undefined", "missing", "no answer", "blank", "keine", "k.a", "aucune", "aucun", "ninguno", "ninguna", "無", "无", "なし", "未定", "待定"}
# Labels that may stand beside a repeated question without adding anything (letters only, case folded).
LABELS = ("q", "a", "question", "answer", "prompt", "response", "youasked", "yourquestion", "yourquestionwas", "yourquestionis", "frage", "antwort", "ihrefrage", "ihrefragelautet", "siefragten", "siefragen", "réponse", "votrequestion", "votrequestionest", "vousavezdemandé", "vousdemandez", "pregunta", "respuesta", "supregunta", "supreguntaes", "ustedpreguntó", "問", "答", "問題", "回答", "您的問題", "您的問題是", "你的問題是", "您問的是", "问题", "您的问题是", "質問", "ご質問", "ご質問は", "お尋ね")
# Names of languages, by their code.
LANGUAGES = {
    "en": "english|englisch|anglais|inglés|inglese|英文|英語|英语",
    "de": "german|deutsch|deutscher|allemand|alemán|德文|德語|德语|ドイツ語",
    "fr": "french|französisch|français|francés|法文|法語|法语|フランス語",
    "es": "spanish|spanisch|espagnol|español|castellano|西班牙文|西班牙語|西班牙语|スペイン語",
    "zh": "chinese|mandarin|chinesisch|chinois|chino|中文|漢語|汉语|華語|中国語",
    "ja": "japanese|japanisch|japonais|japonés|日文|日語|日语|日本語",
}

_QUOTED = regex.compile(r"\"[^\"]*\"|“[^”]*”|„[^“”]*[“”]|«[^»]*»|「[^」]*」|『[^』]*』|```.*?(?:```|$)", regex.S)
_HIDDEN = regex.compile(r"[\p{Cf}\p{Cc}]+")
_OTHER = regex.compile(r"[^\p{L}\p{N}]+")
_ASIDE = regex.compile(r"[\s–—-]*[\[(（][^\])）]*[\])）]\s*$|\s+[–—-]\s+\S+\s*$")
_ASKED = regex.compile(r"^[^:：]{0,40}[:：]\s*")
_CJK = r"\p{Han}\p{Hiragana}\p{Katakana}ー"
_WORD = regex.compile(rf"[{_CJK}]|[^\W{_CJK}]+(?:[.\-/:'’][^\W{_CJK}]+)*|[^\w\s]")
_DIGITS = regex.compile(r"\p{N}+")
_STOP = ".!?。！？｡．؟।"
_CLOSE = "\"'”’»)）」』]】*_`"
_LIST = regex.compile(r"\s*(?:\p{N}+[.)]|[-*•])\s*")


def letters(text: str) -> str:
    return _OTHER.sub("", unicodedata.normalize("NFKC", text).casefold())


def is_empty(answer: str | None) -> bool:
    """Null, blank (also by invisible characters alone), punctuation alone, or a placeholder."""
    if answer is None:
        return True
    a = _HIDDEN.sub("", unicodedata.normalize("NFKC", answer)).strip().strip("()[]{}<>\"'*_`- .。…").casefold()
    return not any(c.isalnum() for c in a) or a in PLACEHOLDERS


def is_copy(question: str | None, answer: str) -> bool:
    """The answer is the question, once or more, with nothing beside it but labels. The question may lack a remark at its end and what leads up
    to it; its letters without both lie in those of all other forms, so an answer without them is no copy of any."""
    a = letters(answer)
    whole = question or ""
    bare = _ASIDE.sub("", whole)
    core = letters(_ASKED.sub("", bare))
    if core and core not in a:
        return False
    for q in dict.fromkeys((letters(whole), letters(bare), core)):
        if len(q) >= 4 and q in a:
            rest = a.replace(q, "\0").strip("\0")
            if all(part in LABELS for part in rest.split("\0") if part):
                return True
    return False


_RUN = regex.compile(rf"[{_CJK}]+|[\p{{L}}\p{{M}}]+")


def runs(text: str) -> list[str]:
    """Words, and runs of Chinese or Japanese characters."""
    return _RUN.findall(unicodedata.normalize("NFKC", text).casefold())


def grams(w: str) -> list[str]:
    """Character n-grams of a word: 1 to 3 with word edges; in Chinese and Japanese 1 and 2."""
    if w[0] >= "\u2e80":
        return [*w, *(w[i : i + 2] for i in range(len(w) - 1))]
    e = f" {w} "
    return [*w, *(e[i : i + n] for n in (2, 3) for i in range(len(e) - n + 1))]


#: Labelled documents that a language needs.
LEAST_LABELLED = 20


def language_model(documents: DataFrame, per_language: int = 2000) -> tuple[list[str], dict[str, np.ndarray]]:
    """Languages and, for each n-gram, its log-probability in each of them.

    documents: doc_id, lang, text. Labels are compared without case and region (en-US is en); a label of fewer than LEAST_LABELLED
    documents is too little to fit a language on. The sample of each language is bounded by `per_language` documents (in expectation).
    """
    label = F.lower(F.split(F.trim("lang"), "[-_]")[0])
    labelled = documents.filter("text is not null and lang is not null").select("doc_id", label.alias("lang"), "text")
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().filter(f"lang rlike '^[a-z]{{2,3}}$' and count >= {LEAST_LABELLED}").collect()}
    langs = sorted(sizes)
    if not langs:
        return [], {}
    rate = F.element_at(F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, per_language / sizes[k])))]), F.col("lang"))
    sample = labelled.filter(F.col("lang").isin(langs)).filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rate * 1_000_000).select("lang", "text")

    def update(counter: Counter, rows: list) -> None:
        for lang, text in rows:
            counter.update(zip(repeat(lang), runs(text)))

    def apart(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:  # a distinct word is taken apart once, with its count
            counter: Counter = Counter()
            for key, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lang, w = key.split("\t", 1)
                for g in grams(w):
                    counter[f"{lang}\t{g}"] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(counter), pa.string()), pa.array(list(counter.values()), pa.int64())], names=["key", "n"])

    counts = key_counts(sample, update, "\t".join).mapInArrow(apart, "key string, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    kept = counts.filter("n >= 2").collect()  # n-grams of a bounded sample
    at = {k: i for i, k in enumerate(langs)}
    table: dict[str, np.ndarray] = {}
    sums = np.zeros(len(langs))
    for r in kept:
        lang, g = r["key"].split("\t", 1)
        table.setdefault(g, np.zeros(len(langs)))[at[lang]] += r["n"]
        sums[at[lang]] += r["n"]
    v = len(table) + 1
    return langs, {g: np.log((n + 0.5) / (sums + 0.5 * v)).astype(np.float32) for g, n in table.items()}


#: A worker's sums of the n-grams of the words it has met, with the model they belong to.
_sums: list = [None, {}]


def posterior(text: str, langs: list[str], table: dict[str, np.ndarray]) -> np.ndarray:
    """Log-posterior of each language under equal priors; equal values where nothing is known."""
    s = np.zeros(len(langs))
    if _sums[0] is not table:
        _sums[:] = table, {}
    cache = _sums[1]
    for w in runs(text):
        v = cache.get(w)
        if v is None:
            found = [x for g in grams(w) if (x := table.get(g)) is not None]
            v = np.sum(found, axis=0, dtype=np.float64) if found else np.zeros(len(langs))
            if len(cache) < 200_000:
                cache[w] = v
        s += v
    s -= s.max()
    return s - math.log(np.exp(s).sum())


def shape(word: str) -> str:
    return _DIGITS.sub("0", word.casefold())


#: Responses of so many words are also counted as a whole: a short answer that is often given is no fragment.
SHORT = 8


def words(text: str) -> list[str]:
    """The shapes of the words and marks of a text: small letters, and 0 for each run of digits."""
    return _WORD.findall(shape(unicodedata.normalize("NFKC", text)))


def count_ends(counter: Counter, texts: list) -> None:
    """Contexts of one to three words behind e where a sentence ends with them and c where it goes on; the same with ^ for a text's
    first words and the text's end."""
    for text in texts:
        if text is None:
            continue
        w = words(text)
        counter["#"] += len(w)
        for n in range(1, min(len(w), SHORT) + 1):
            counter[("e" if n == len(w) else "c", "^", *w[:n])] += 1
        flags: list[str | None] = []
        for i in range(len(w) - 1):
            if w[i] in _STOP or w[i] == "…" or w[i] in _CLOSE:
                flags.append(None)  # no word
                continue
            k = i + 1
            if w[k] in _CLOSE:
                while k + 1 < len(w) and w[k] in _CLOSE:  # a quotation that is closed before the full stop
                    k += 1
            end = w[k] in _STOP and (w[k] != "." or k + 1 >= len(w) or w[k + 1] not in ".,;")
            flags.append("e" if end else "c")
        counter.update(zip(flags, w, strict=False))
        counter.update(zip(flags[1:], w, w[1:], strict=False))
        counter.update(zip(flags[2:], w, w[1:], w[2:], strict=False))


def spell_context(key: str | tuple) -> str | None:
    if isinstance(key, str):
        return key
    return None if key[0] is None else key[0] + " ".join(key[1:])


def end_model(texts: DataFrame) -> DataFrame:
    """(key, ends, n): contexts that occur twice or more in the texts of the single column, and how often a sentence ends with them."""
    counts = key_counts(texts, count_ends, spell_context).filter("key <> '#'")
    both = counts.groupBy(F.expr("substring(key, 2)").alias("key")).agg(F.sum(F.when(F.col("key").startswith("e"), F.col("n")).otherwise(0)).alias("ends"), F.sum("n").alias("n"))
    return both.filter("n >= 2")


def last_contexts(w: list[str]) -> list[str | None]:
    """The contexts that tell of the end of a text of words w: its last word, two and three words, and, if it is short, its whole."""
    return [" ".join(w[-n:]) if len(w) >= n else None for n in (1, 2, 3)] + ["^ " + " ".join(w) if len(w) <= SHORT else None]


def end_likelihood(found: list[tuple[int, int]], weight: float = 3.0) -> tuple[float, int]:
    """Probability that a sentence ends after words whose contexts were found so often (ends, all), from one word to three, and how often
    the longest known context was seen."""
    p, seen = 0.1, 0
    for ends, n_all in found:
        p = (ends + weight * p) / (n_all + weight)
        seen = n_all if n_all else seen
    return p, seen


def ending(answer: str) -> bool | tuple[list[str | None], bool, bool, bool]:
    """Whether the form of an answer tells that it breaks off, or that it does not; or else the contexts of its last words, whether it is
    closed, whether by a full stop behind more than three words, and whether it is as brief as a name or number."""
    text = unicodedata.normalize("NFKC", answer).strip()
    if text.count("```") % 2:
        return True
    if text.endswith("```"):
        return False
    last = text.splitlines()[-1] if text else ""
    if _LIST.fullmatch(last) and len(text) > len(last):
        return True
    body = text.rstrip(_CLOSE)
    if text.endswith("`") and text.count("`") % 2 == 0:
        return False
    w = words(text)
    while w and w[-1] in _CLOSE:
        w.pop()
    closed = bool(w) and (w[-1] in _STOP or w[-1] == "…")
    while w and (w[-1] in _STOP or w[-1] == "…" or w[-1] in _CLOSE):
        w.pop()
    if not w:
        return False
    if not closed and (text[-1] in "([{（「『“„«,，、;；:：>/&+=–—-" or body[-1:] in "([{（「『“„«"):
        return True
    whole = sum(any(c.isalnum() for c in x) for x in w)
    full = text.endswith(".") and whole > 3
    if closed and not full:
        return False
    return last_contexts(w), closed, full, whole <= 4 and len(text) <= 24 and "\n" not in text


def breaks_off(found: list[tuple[int, int] | None], closed: bool, brief: bool, open_end: float = 0.05, closed_end: float = 0.005) -> bool:
    """found: (ends, all) of each of last_contexts(), (0, 0) where it is not known, None where there is none."""
    p, seen = end_likelihood([x for x in found[:3] if x])
    if closed:
        return seen >= 20 and p < closed_end
    if found[3] and found[3][1] >= 5:
        ends, n = found[3]
        return ends < 0.3 * n and p < open_end
    if brief:
        return seen >= 20 and p < closed_end and found[0][0] == 0
    return p < open_end if seen else True


def is_truncated(answer: str, model: dict[str, tuple[int, int]]) -> bool:
    """Breaks off before its sentence, list or code is complete, by a whole model."""
    end = ending(answer)
    if isinstance(end, bool):
        return end
    contexts, closed, _, brief = end
    return breaks_off([None if c is None else model.get(c, (0, 0)) for c in contexts], closed, brief)


def asks_for(question: str, lang: str) -> bool:
    names = LANGUAGES.get(lang)
    return bool(names) and regex.search(rf"(?<!\p{{L}})(?:{names})(?!\p{{L}})" if names.isascii() else names, question.casefold()) is not None


def is_foreign(question: str, answer: str, langs: list[str], table: dict[str, np.ndarray], margin: float = 6.0, least: int = 15) -> bool:
    """The posteriors of question and answer peak at different languages, each by `margin` nats over the other's peak, and the
    question does not ask for the answer's language. An answer of fewer than `least` letters (a Chinese or Japanese character
    counts as four) is too short to tell."""
    if not langs or sum(4 if ord(c) >= 0x3040 else 1 for c in letters(answer) if c.isalpha()) < least:
        return False
    q, a = posterior(question, langs, table), posterior(_QUOTED.sub(" ", answer), langs, table)
    i, j = int(q.argmax()), int(a.argmax())
    return i != j and q[i] - q[j] >= margin and a[j] - a[i] >= margin and not asks_for(question, langs[j])


def history_pairs(requests: DataFrame, traces: DataFrame) -> DataFrame:
    """(request_id, item_index, q, a): the pairs of context by position, and question with generated_answer as -1 for requests
    that have a trace. Rows delivered more than once count once; null ids are left out."""
    once = latest(requests, "request_id", "received_at", "context", "question")
    items = once.select("request_id", F.posexplode("context").alias("item_index", "_c")).select("request_id", "item_index", F.col("_c.q").alias("q"), F.col("_c.a").alias("a"))
    answers = latest(traces, "request_id", "logged_at", "generated_answer")
    return items.unionByName(once.join(answers, "request_id").select("request_id", F.lit(-1).alias("item_index"), F.col("question").alias("q"), F.col("generated_answer").alias("a")))


JUDGED = "request_id string, item_index int, defect string, closed boolean, brief boolean, contexts array<struct<place:int,key:string,ends:bigint,n:bigint>>"


def find_defects(pairs: DataFrame, documents: DataFrame, per_language: int = 2000, heavy: int = 100_000) -> DataFrame:
    """(request_id, item_index, defect): the first defect of each defective pair (request_id, item_index, q, a).

    A null question can only have an empty, refusing or truncated answer. An empty table gives an empty result.
    """
    spark = pairs.sparkSession
    pairs = pairs.select("request_id", F.col("item_index").cast("int").alias("item_index"), "q", "a")
    # read three times; in as many tasks as a shuffle has, as the work is in Python and not in proportion to the bytes by which tasks are merged
    pairs = durable(pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "request_id", "item_index"))
    langs, table = language_model(documents, per_language)
    refusing = refusal_model(pairs.select("a"))
    ends = durable(end_model(pairs.select("a")))
    total = ends.agg(F.sum("n")).head()[0] or 0
    most = F.col("n") * heavy >= total
    sent = {r["key"]: (r["ends"], r["n"]) for r in ends.filter(most).collect()}  # at most `heavy` rows
    shared = spark.sparkContext.broadcast((langs, table, sent, refusing))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table, sent, refusing = shared.value
        for b in it:
            rows = []
            for r in b.to_pylist():
                q, a = r["q"], r["a"]
                closed = brief = contexts = None
                if is_empty(a):
                    d = "empty"
                elif q and is_copy(q, a):
                    d = "copy"
                elif declines(a, refusing):
                    d = "refusal"
                elif q and is_foreign(q, a, langs, table):
                    d = "language"
                else:
                    end = ending(a)
                    if isinstance(end, bool):
                        d = "truncated" if end else None
                    else:
                        keys, closed, _, brief = end
                        found = [None if k is None else sent.get(k) for k in keys]
                        if all(k is None or x for k, x in zip(keys, found, strict=True)):
                            d = "truncated" if breaks_off(found, closed, brief) else None
                        else:
                            d = None
                            contexts = [{"place": i, "key": None if x else k, "ends": x and x[0], "n": x and x[1]} for i, (k, x) in enumerate(zip(keys, found, strict=True)) if k is not None]
                if d or contexts:
                    rows.append({"request_id": r["request_id"], "item_index": r["item_index"], "defect": d, "closed": closed, "brief": brief, "contexts": contexts})
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    judged = durable(pairs.mapInArrow(batches, JUDGED))
    asked = judged.filter("defect is null")
    of = ["request_id", "item_index"]
    every = asked.select(*of, "closed", "brief", F.explode("contexts").alias("_c")).select(*of, "closed", "brief", "_c.*")
    joined = every.filter("key is not null").drop("ends", "n").join(ends.filter(~most), "key", "left").select(*every.columns)
    parts = every.filter("key is null").unionByName(joined).groupBy(*of).agg(F.first("closed").alias("closed"), F.first("brief").alias("brief"), F.collect_list(F.struct("place", F.coalesce("ends", F.lit(0)).alias("ends"), F.coalesce("n", F.lit(0)).alias("n"))).alias("contexts"))  # at most four a response

    def decide(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for r in b.to_pylist():
                found: list = [None] * 4
                for c in r["contexts"]:
                    found[c["place"]] = c["ends"], c["n"]
                if breaks_off(found, r["closed"], r["brief"]):
                    rows.append({"request_id": r["request_id"], "item_index": r["item_index"], "defect": "truncated"})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(_SCHEMA)[:3]))

    return judged.filter("defect is not null").select(*of, "defect").unionByName(parts.mapInArrow(decide, "request_id string, item_index int, defect string"))


_SCHEMA = pa.schema(
    [
        ("request_id", pa.string()), ("item_index", pa.int32()), ("defect", pa.string()), ("closed", pa.bool_()), ("brief", pa.bool_()),
        ("contexts", pa.list_(pa.struct([("place", pa.int32()), ("key", pa.string()), ("ends", pa.int64()), ("n", pa.int64())]))),
    ]
)
