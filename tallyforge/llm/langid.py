"""Language identification with interpolated Kneser-Ney character models.

Learning. Every training text is lower-cased, cut to letters and single spaces, and its
n-grams of ORDER characters are counted per language: per batch in numpy, then added up
by Spark over the whole corpus. From these counts joins and aggregates make the interpolated
Kneser-Ney model of each language: discounted counts at the highest order, continuation
counts below, the uniform distribution at the end. Discounts, n1 / (n1 + 2 n2) of an order,
and continuation counts come from all n-grams.

Storage. A log probability is a sum over n-grams: what a language has of the character alone,
then, for each longer n-gram that ends with it, the log back-off weight of its context and,
if the language has the n-gram, its gain, the log of its probability over the backed-off one. So the model is
a table of n-grams with gain and weight that can be looked up anywhere and added up. An n-gram's
characters are packed in 64 bits and multiplied by an odd constant, with the order mixed in; the
broadcast part is, for each order, one sorted array of these hashes, and under each hash the
languages that have the n-gram with its gain and weight. It holds MODEL_ENTRIES n-grams at most,
the most frequent ones (the cutoff is a count read from a histogram). The rest stays a table:
a bit table tells the walk over the documents which n-grams are in it; these are joined with it,
and what they give is added to the document's sums. No n-gram is left out, whatever their number.

Small models. Only where a caller of train() asks for at most so many entries, each language stores the
most frequent n-grams of each order from 2 on, and the probability of the others goes to the
back-off weight of their context, so that a context's probabilities still sum to one. No query does.

Prediction. The language of least cross-entropy per character. A document is rejected if
its cross-entropy is far above what its language's texts have: standardised by the square
root of its length and compared with MARGIN times a high quantile of the same figure over all
correctly predicted calibration texts, an eighth of the labelled ones that the models have not
seen. (On texts the models have seen the figure is too low, and too many others are rejected.) `score` is the softmax of the negative
cross-entropies, sharpened by the length up to SHARP characters.

Edge cases: null text and text without letters give `und`, score 0, and are rejected.
Without training rows every text gives `und`. Null languages, and texts without letters,
are not learned from. Ties go to the language that sorts first. Repeated rows count and
are predicted each on their own. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import slices, table
from tallyforge.llm.phrases import _filter, told
from tallyforge.llm.words import mix
from tallyforge.plans.rows import drop_rows
from tallyforge.plans.scratch import materialise

ORDER = 4
#: Most n-grams of all languages and orders in the broadcast part of the model, about 30 bytes each; the others are joined.
MODEL_ENTRIES = 8_000_000
SHARP = 60
#: Rejection: the quantile of the calibration texts' standardised excess, and how far beyond it a text must be.
QUANTILE, MARGIN = 0.999, 3.0
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def clean(text: str | None) -> str:
    """Lower-case letters with one space between, before and after words; empty without letters."""
    words = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return f" {words} " if words else ""


def packed(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram ending at each character, number of its characters, text index); a character has 16 bits.

    Characters beyond the 16-bit range are folded into it. At a text's start the n-grams are shorter.
    """
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    code = np.where(chars > 0xFFFF, 0xE000 + chars % 0x1800, chars).astype(np.uint64)
    sizes = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    gram = code.copy()
    for k in range(1, order):
        before = np.zeros_like(code)
        before[k:] = code[:-k]
        before[place < k] = 0
        gram |= before << np.uint64(16 * k)
    return gram, np.minimum(place + 1, order), owner


def hashed(gram: np.ndarray, n: int) -> np.ndarray:
    return (gram ^ (np.uint64(n) << np.uint64(61))) * _ODD if n < ORDER else gram * _ODD + np.uint64(1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of one task: counts are added up over its batches and given out when there are many."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def give(lang: str) -> pa.RecordBatch:
        grams, counts = _added(held.pop(lang))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])

    for batch in slices(batches, limit=2_000_000):
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if t := clean(text):
                by_lang.setdefault(lang, []).append(t)
        for lang, texts in by_lang.items():
            gram, size, _ = packed(texts)
            found = np.unique(gram[size == ORDER], return_counts=True)
            held.setdefault(lang, []).append(found)
            if len(held[lang]) >= 16:
                held[lang] = [_added(held[lang])]
            if sum(len(g) for g, _ in held[lang]) > 2_000_000:
                yield give(lang)
    for lang in list(held):
        yield give(lang)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(grams)).astype(np.int64)


def ngram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows (lang, text)."""
    parts = labelled.where("lang is not null and text is not null").select("lang", "text").mapInArrow(_count, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def cutoffs(counts: DataFrame, most: int) -> dict[str, int]:
    """Each language's least power of two that leaves at most `most` of its rows (lang, gram, n)."""
    level = F.floor(F.log2("n")).cast("int")
    sizes = counts.groupBy("lang", level.alias("level")).agg(F.count("*").alias("grams")).collect()  # at most 63 rows a language
    cutoff = {}
    for lang in {r["lang"] for r in sizes}:
        total, cutoff[lang] = 0, 2**62
        for r in sorted((r for r in sizes if r["lang"] == lang), key=lambda r: -r["level"]):
            total += r["grams"]
            if total > most:
                break
            cutoff[lang] = 2 ** r["level"]
    return cutoff


def _of_lang(values: dict[str, float], kind: str) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), F.col("lang")).cast(kind)


def kneser_ney(counts: DataFrame, entries: int | None = None) -> tuple[list[DataFrame], dict[str, int]]:
    """For the orders 1 to ORDER (lang, gram, gain, back, uses) of all n-grams, and how many characters each language has.

    gain: the log of the n-gram's probability over the backed-off one; back: its log weight as a context; uses: how often it occurs.
    counts: (lang, gram, n) of all n-grams of the highest order, stored. entries: off by default; with it only about so many are stored.
    """
    levels = [counts.withColumn("raw", F.col("n"))]
    for n in range(ORDER - 1, 0, -1):  # continuation counts: in how many longer n-grams one is the end
        shorter = levels[0].groupBy("lang", F.col("gram").bitwiseAND(F.lit(_mask(n))).alias("gram")).agg(F.count("*").alias("n"), F.sum("raw").alias("raw"))
        levels.insert(0, materialise(shorter, "ngrams"))
    figures = [{r["lang"]: r for r in c.groupBy("lang").agg(F.count("*").alias("grams"), F.sum((F.col("n") == 1).cast("long")).alias("ones"), F.sum((F.col("n") == 2).cast("long")).alias("twos")).collect()} for c in levels]  # one row a language
    langs = sorted(figures[0])
    if not langs:
        return [], {}
    kinds = {x: figures[0][x]["grams"] for x in langs}
    stored: list[DataFrame] = []
    pruned = [False]
    for n, (c, of) in enumerate(zip(levels, figures, strict=True), 1):
        most = max(1, entries // (ORDER * len(langs))) if entries is not None else None
        least = cutoffs(c, most) if most and n > 1 and max(of[x]["grams"] for x in langs) > most else dict.fromkeys(langs, 1)
        pruned.append(max(least.values()) > 1)
        discount = {x: float(np.clip(of[x]["ones"] / (of[x]["ones"] + 2 * of[x]["twos"]), 0.1, 0.9)) if of[x]["ones"] else 0.5 for x in langs}
        own = c.withColumn("context", F.shiftrightunsigned("gram", 16)).withColumn("less", F.greatest(F.col("n") - _of_lang(discount, "double"), F.lit(0.0))).withColumn("kept", F.col("n") >= _of_lang(least, "long"))
        context = own.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("kept"), F.col("less")).otherwise(0.0)).alias("mass"), F.sum("raw").alias("met"))
        context = materialise(context.withColumn("gamma", 1 - F.col("mass") / F.col("total")).drop("mass"), "contexts")
        rows = own.where("kept").join(context, ["lang", "context"])
        if n == 1:
            rows = rows.withColumn("below", 1.0 / (_of_lang({x: float(of[x]["grams"]) for x in langs}, "double") + 1))
        else:
            # a context that stored n-grams have is kept for its weight, even if its own count is too low; its p is then null
            weight = context.where("gamma < 1").select(F.col("lang"), F.col("context").alias("gram"), F.col("gamma").alias("back"), "met")
            stored[-1] = materialise(stored[-1].join(weight, ["lang", "gram"], "full").withColumn("back", F.coalesce("back", F.lit(1.0))), "model")
            rows = _below(rows, n - 1, stored, pruned)
        backed = F.log("gamma") + F.log("below") if n > 1 else _of_lang({x: float(unseen(kinds[x])) for x in langs}, "double")
        rows = rows.withColumn("p", F.col("less") / F.col("total") + F.col("gamma") * F.col("below"))
        stored.append(materialise(rows.select("lang", "gram", "p", (F.log("p") - backed).alias("gain"), "raw"), "model"))
    stored[-1] = stored[-1].withColumn("back", F.lit(1.0)).withColumn("met", F.col("raw"))
    uses = F.greatest("raw", "met").alias("uses")
    return [s.select("lang", "gram", F.coalesce("gain", F.lit(0.0)).cast("float").alias("gain"), F.log("back").cast("float").alias("back"), uses) for s in stored], kinds


def unseen(kinds: int) -> float:
    """Log probability of a character that the language does not have."""
    return -np.log(kinds + 1) - 1


def split(orders: list[DataFrame], entries: int) -> tuple[list[DataFrame], DataFrame | None]:
    """The orders with their most frequent n-grams, `entries` at most of all orders together, and (size, lang, gram, gain, back) of the rest, if there is one."""
    if sum(rows.count() for rows in orders) <= entries:
        return orders, None
    every = None
    for n, rows in enumerate(orders, 1):
        own = rows.select(F.lit(n).alias("size"), "*")
        every = own if every is None else every.unionByName(own)
    least = cutoffs(every.select(F.lit("").alias("lang"), F.col("uses").alias("n")), entries)[""]
    return [rows.where(F.col("uses") >= least) for rows in orders], every.where(F.col("uses") < least).drop("uses")


def _mask(n: int) -> int:
    return (1 << (16 * n)) - 1


def _below(rows: DataFrame, n: int, stored: list[DataFrame], pruned: list[bool]) -> DataFrame:
    """rows with below: the probability of the last n characters of gram, by the stored n-grams of order n or less."""
    tail = F.col("gram").bitwiseAND(F.lit(_mask(n)))
    found = rows.withColumn("tail", tail).join(stored[n - 1].select("lang", F.col("gram").alias("tail"), F.col("p").alias("below")), ["lang", "tail"], "left").drop("tail")
    if not pruned[n] or n == 1:
        return found
    own, weight, context = f"own{n}", f"weight{n}", f"context{n}"
    weights = stored[n - 2].select("lang", F.col("gram").alias(context), F.col("back").alias(weight))
    backed = _below(found.withColumnRenamed("below", own), n - 1, stored, pruned).withColumn(context, F.shiftrightunsigned(tail, 16)).join(weights, ["lang", context], "left")
    return backed.withColumn("below", F.coalesce(own, F.coalesce(weight, F.lit(1.0)) * F.col("below"))).drop(own, weight, context)


class Models:
    """Models of all languages: per order a sorted array of hashes, and under each the languages' entries."""

    def __init__(self, orders: list[pa.Table], kinds: dict[str, int]):
        """orders: (lang, gram, gain, back) for each order from 1 on; kinds: how many characters each language has."""
        self.langs = sorted(kinds)
        self.tables = []
        for n, rows in enumerate(orders, 1):
            lang = pa.compute.index_in(rows["lang"], value_set=pa.array(self.langs, pa.string())).to_numpy().astype(np.int32)
            key = hashed(rows["gram"].to_numpy().view(np.uint64), n)
            order = np.argsort(key, kind="stable")
            keys, first = np.unique(key[order], return_index=True)
            gain, back = (rows[c].to_numpy()[order] for c in ("gain", "back"))
            self.tables.append((keys, np.append(first, len(order)).astype(np.int64), lang[order], gain, back))
        self.unseen = np.array([unseen(kinds[x]) for x in self.langs], np.float32)

    def _add(self, n: int, grams: np.ndarray, out: np.ndarray, back: bool) -> None:
        """Add to out (an n-gram a row, a language a column) what the model stores of the distinct n-grams."""
        keys, first, lang, gain, weights = self.tables[n - 1]
        i, known = _find(keys, hashed(grams, n))
        rows = np.flatnonzero(known)
        size = first[i[rows] + 1] - first[i[rows]]
        entry = np.repeat(first[i[rows]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        out[np.repeat(rows, size), lang[entry]] += (weights if back else gain)[entry]

    def look(self, grams: np.ndarray, n: int) -> np.ndarray:
        """Log probabilities of distinct n-grams, a column a language: the character alone, and what each longer n-gram adds."""
        if n == 1:
            out = np.repeat(self.unseen[None, :], len(grams), axis=0)
        else:
            tails, at = np.unique(grams & np.uint64(_mask(n - 1)), return_inverse=True)
            out = self.look(tails, n - 1)[at]
            contexts, at = np.unique(grams >> np.uint64(16), return_inverse=True)
            weight = np.zeros((len(contexts), len(self.langs)), np.float32)
            self._add(n - 1, contexts, weight, back=True)
            out += weight[at]
        self._add(n, grams, out, back=False)
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per character in nats, one column a language; characters) of each cleaned text."""
        total = np.zeros((len(texts), len(self.langs)))
        gram, size, owner = packed(texts)
        for n in range(2, ORDER + 1):  # the first space is given
            own = np.flatnonzero(size == n)
            if not len(own):
                continue
            grams, at = np.unique(gram[own], return_inverse=True)
            logp = self.look(grams, n)
            heads = np.flatnonzero(np.concatenate(([True], owner[own][1:] != owner[own][:-1])))
            for start in range(0, len(self.langs), 16):  # a few languages at once, so the gathered rows stay small
                part = np.ascontiguousarray(logp[:, start : start + 16])
                total[owner[own][heads], start : start + 16] -= np.add.reduceat(part[at], heads, axis=0, dtype=np.float64)
        count = np.maximum(np.array([len(t) for t in texts]) - 1, 0)
        return total / np.maximum(count, 1)[:, None], count


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return i, keys[i] == wanted


def _models(orders: list[DataFrame], kinds: dict[str, int]) -> Models:
    return Models([rows.select("lang", "gram", "gain", "back").toArrow() for rows in orders], kinds)


def train(labelled: DataFrame, entries: int | None = None) -> Models:
    """Models from all rows (lang, text) in one piece, which the driver holds; entries: only about so many n-grams, the others by back-off."""
    return _models(*kneser_ney(materialise(ngram_counts(labelled), "ngrams"), entries))


def _told_as(grams: np.ndarray, n: int) -> np.ndarray:
    """Keys of n-grams in the bit table."""
    return mix(hashed(grams, n))


def _told_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, gram = batch.column("size").to_numpy(), batch.column("gram").to_numpy().view(np.uint64)
        keys = np.zeros(len(size), np.uint64)
        for n in range(1, ORDER + 1):
            keys[size == n] = _told_as(gram[size == n], n)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])


def lookups(texts: list[str], bits: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text index, size, gram, times it ends, times it is a context) of what entropies() of texts looks up and the bit table holds."""
    gram, size, owner = packed(texts)
    found = []
    for n in range(2, ORDER + 1):
        own = np.flatnonzero(size == n)
        grams, at = np.unique(gram[own], return_inverse=True)
        for m in range(1, n + 1):
            for context in (False, True)[: 2 if m < n else 1]:
                part = (grams >> np.uint64(16) if context else grams) & np.uint64(_mask(m)) if m < ORDER else grams
                hit = told(bits, _told_as(part, m))[at]
                who = owner[own][hit]
                found.append((who, np.full(len(who), m), part[at[hit]], np.full(len(who), not context), np.full(len(who), context)))
    who, m, part, ends, contexts = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((part, m, who))
    who, m, part = who[order], m[order], part[order]
    new = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (m[1:] != m[:-1]) | (part[1:] != part[:-1])))) if len(who) else np.empty(0, np.int64)
    sums = (np.add.reduceat(x[order].astype(np.int64), new) if len(new) else np.empty(0, np.int64) for x in (ends, contexts))
    return who[new], m[new], part[new], *sums


#: Characters of one text that are scored at once.
CHUNK = 500_000


def _pieces(t: str) -> list[str]:
    """The pieces of a text that _scored() takes."""
    return [t] if len(t) <= CHUNK else [t[max(0, at - ORDER + 1) : at + CHUNK + 1] for at in range(0, max(len(t) - 1, 1), CHUNK)]


def _scored(models: Models, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """entropies() of texts of any length: long ones go in chunks that share ORDER - 1 characters."""
    if all(len(t) <= CHUNK for t in texts):
        return models.entropies(texts)
    means, counts = [], []
    for t in texts:
        total, n = 0.0, 0
        for part in _pieces(t):
            gram_part = models.entropies([part])
            total, n = total + gram_part[0][0] * gram_part[1][0], n + gram_part[1][0]
        means.append(total / max(n, 1))
        counts.append(n)
    return np.array(means), np.array(counts)


def _judged(langs: list[str], means: np.ndarray, n: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, cross-entropy) of each text. Cross-entropies are compared at nine decimals, so the order of a sum decides no tie."""
    if not langs:
        return ["und"] * len(n), np.zeros(len(n)), np.zeros(len(n))
    best = means.round(9).argmin(axis=1)
    h = means[np.arange(len(n)), best]
    sharp = np.exp(-(means - h[:, None]) * np.minimum(np.maximum(n, 1), SHARP)[:, None])
    return [langs[b] if k else "und" for b, k in zip(best, n, strict=True)], np.where(n > 0, 1 / sharp.sum(axis=1), 0.0), h


def score(docs: DataFrame, models: Models, keep: list[str], rest: DataFrame | None = None) -> DataFrame:
    """The columns `keep` of docs with n_letters, lang_pred, score, entropy. rest: the n-grams that models does not hold."""
    spark, langs = docs.sparkSession, models.langs
    bits = None if rest is None else _filter(spark, rest.select("size", "gram").distinct().mapInArrow(_told_keys, "key long"))
    shared = spark.sparkContext.broadcast((models, bits))
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def judged(batch: pa.RecordBatch, means: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        lang, p, h = _judged(langs, means, n)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(lang, pa.string()), pa.array(p, pa.float64()), pa.array(h, pa.float64())], [*keep, "n_letters", "lang_pred", "score", "entropy"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, told_bits = shared.value
        for batch in slices(batches, text="__text", limit=1_000_000):
            texts = [clean(t) for t in batch.column("__text").to_pylist()]
            means, n = _scored(m, texts) if langs else (np.zeros((len(texts), 0)), np.zeros(len(texts), np.int64))
            if told_bits is None:
                yield judged(batch, means, n)
                continue
            pieces = [(i, x) for i, t in enumerate(texts) for x in _pieces(t)]
            who, *rows = lookups([x for _, x in pieces], told_bits)
            ends = np.searchsorted(np.array([i for i, _ in pieces])[who], np.arange(len(texts) + 1))
            names, kinds = ["size", "gram", "ends", "contexts"], [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            left = pa.StructArray.from_arrays([pa.array(x.view(np.int64)).cast(k) for x, k in zip(rows, kinds, strict=True)], names)
            own = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * len(langs), pa.int32()), pa.array(means.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), batch.column("__row"), pa.array(n, pa.int64()), own, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), left)], [*keep, "__row", "__n", "__means", "__left"])

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("__n").to_numpy()
            means, more = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(n), len(langs)) for c in ("__means", "__more"))
            yield judged(batch, means - more / np.maximum(n, 1)[:, None], n)

    result = f"{fields}, n_letters long, lang_pred string, score double, entropy double"
    text = F.col("text").cast("string").alias("__text")
    if rest is None:
        return docs.select(*keep, text).mapInArrow(run, result)
    walked = docs.select(*keep, F.monotonically_increasing_id().alias("__row"), text).mapInArrow(run, f"{fields}, __row long, __n long, __means array<double>, __left array<struct<size: int, gram: long, ends: long, contexts: long>>")
    walked = materialise(walked, "langid-walk")  # a row's number is the same from here on
    value = F.col("ends") * F.col("gain").cast("double") + F.col("contexts") * F.col("back").cast("double")
    none = F.array(*(F.lit(0.0) for _ in langs))
    more = walked.select("__row", F.explode("__left").alias("x")).select("__row", "x.*").join(rest, ["size", "gram"])
    more = more.groupBy("__row").agg(F.array(*(F.coalesce(F.sum(F.when(F.col("lang") == x, value)), F.lit(0.0)) for x in langs)).alias("__more"))
    whole = walked.drop("__left").join(more, "__row", "left").withColumn("__more", F.coalesce("__more", none))
    return whole.select(*keep, "__n", "__means", "__more").mapInArrow(ended, result)


def calibrated(scored: DataFrame, learned: Column, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """scored (lang, n_letters, lang_pred, entropy) with rejected, from the rows where `learned` holds and lang is right."""
    right = scored.where(learned & (F.col("lang") == F.col("lang_pred")))
    norm = right.groupBy("lang_pred").agg(F.avg("entropy").alias("mean"), F.coalesce(F.stddev("entropy"), F.lit(0.0)).alias("sd"))
    norm = norm.collect()  # one row a language
    mean = _per_lang({r["lang_pred"]: r["mean"] for r in norm})
    excess = (F.col("entropy") - mean) * F.sqrt(F.least(F.col("n_letters"), F.lit(1000)))
    cut = right.groupBy("lang_pred").agg(F.percentile_approx(excess, quantile, 10000).alias("q")).collect()
    limit = _per_lang({r["lang_pred"]: r["q"] for r in cut})
    far = F.coalesce(excess > F.greatest(limit, F.lit(0.0)) * margin, F.lit(False))
    return scored.withColumn("rejected", (F.col("lang_pred") == "und") | far)


def _per_lang(values: dict[str, float]) -> Column:
    if not values:
        return F.lit(None).cast("double")
    return F.element_at(F.create_map(*(F.lit(x) for k, v in values.items() for x in (k, float(v)))), F.col("lang_pred"))


def _crc(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(_crc(doc_id) % 4 == 2, F.lit(False))


def calibrates(doc_id: Column) -> Column:
    """Of the others, the eighth that only the rejection is calibrated on."""
    return F.coalesce((_crc(doc_id) % 4 != 2) & (F.floor(_crc(doc_id) / 4) % 8 == 5), F.lit(False))


def identify(docs: DataFrame, entries: int = MODEL_ENTRIES) -> DataFrame:
    """doc_id, row_hash, lang, held_out, n_letters, lang_pred, score, entropy, rejected of every row of docs (doc_id, text, lang).

    entries: n-grams in the broadcast part of the model; more of them are joined, with the same result.
    """
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), held_out(F.col("doc_id")).alias("held_out"), F.xxhash64("doc_id", "text").alias("row_hash"))
    labelled = own.where(~F.col("held_out") & ~calibrates(F.col("doc_id")))
    orders, kinds = kneser_ney(materialise(ngram_counts(labelled), "ngrams"))
    orders, rest = split(orders, entries)
    scored = materialise(score(own, _models(orders, kinds), ["doc_id", "row_hash", "lang", "held_out"], rest), "langid")
    return calibrated(scored, calibrates(F.col("doc_id")))


def op3_kneser_ney_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, held_out, lang_pred, score, rejected."""
    return identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def stay(docs: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected, with all columns."""
    found = identify(docs)
    gone = found.where("rejected").select(F.col("doc_id").alias("id"), F.col("row_hash").alias("mark")).distinct()
    return drop_rows(docs, "doc_id", F.xxhash64("doc_id", "text"), gone, gone.limit(0))
