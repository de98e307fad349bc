"""Phrase collocations by mergeable Misra-Gries summaries.

A phrase of 1 to 5 words is frequent in a language if it occurs `least` times or more. Which
ones are is found without counting them all:
1. a walk over the texts adds up the mass (occurrences) of each of SLOTS hash partitions;
2. a second walk sends each task's own n-gram counts to their hash partitions. There they are
   merged into one Misra-Gries summary a slot, of ROOM * mass / least counters: when more are
   held, the count just beyond the capacity is taken off all. What a slot has taken off is at
   most mass / (capacity + 1) < least, and a counter plus that is at least the true count, so
   every frequent n-gram is among those whose sum reaches `least`;
3. the last walk counts the survivors exactly. What a task has counted goes to the survivors'
   buckets, a row for each bucket and language, and is added up there for the survivors alone.
The first two steps are taken for one and two words, then for three to five, of which only
those made of surviving pairs are posted. Survivors are told to the next walk by a bit table
of FILTER_BITS bits, whatever their number: what it lets through in error costs a little of
the exact count and changes nothing.

A candidate (2 words or more) is scored by its weakest cut, floor(1000 a n / (l r)) with
a, l, r the counts of the phrase and its two parts and n the language's words, in exact
decimals. The parts of a frequent phrase are frequent, so both are in the same table. A
candidate is dropped if a longer one that contains it occurs as often. Counts do not rise
with length, so it is enough to look one word further. Ranks come from running sums over
range partitions, as one language may hold most rows.

Phrases are told apart by 64-bit hashes of (language, words).

Edge cases: a null or empty text has no words; a null language is `und`, together with rows
that say so. Only A-Z are lower-cased. Repeated rows and ids count each. Equal scores go by
count, then by the phrase's UTF-8 bytes. Empty tables give no rows. Only text and lang are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import slices, table, text_bytes
from tallyforge.llm.words import LOWER, mix, ngram_hashes, word_hashes
from tallyforge.plans.prefix import running_sums
from tallyforge.plans.scratch import materialise
from tallyforge.plans.skew import lookup

LONGEST, LEAST, TOP = 5, 100, 2000
#: Hash partitions of the summaries: the upper bits of an n-gram's hash.
SLOT_BITS = 16
#: Counters of a slot, as a multiple of mass / least.
ROOM = 2
#: Bits of the table that tells survivors: 16 MB, the same for every size of corpus.
FILTER_BITS = 1 << 27
#: N-gram counts that a task holds before it sends them on, phrases that the last walk holds, and rows of an Arrow batch.
HELD, SPELLED, SENT = 3_000_000, 300_000, 250_000
#: Survivors that are counted together in the last walk.
BUCKET = 20_000
_ENDS = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else LOWER[c] for c in range(256))


class Words:
    """The words of a batch: their texts joined, where each begins, their hashes, where each document begins, and their pieces."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        texts = [t.translate(_ENDS) for t in text_bytes(batch.column("text"))]
        self.data = b"\n".join(texts)
        self.hashes, self.at = word_hashes(texts)
        b = np.frombuffer(b"\n" + self.data, np.uint8)
        gap = (b == 10) | (b == 32) | (b == 9)
        self.starts = np.flatnonzero(gap[:-1] & ~gap[1:])
        self.piece = np.cumsum(b[1:] == 10)[self.starts]
        self.langs = batch.column("lang").to_pylist()

    def grams(self, passed: np.ndarray | None, sizes: range) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, positions, keys) of the n-grams of each size that stay within a piece; those of three words and more only where all their pairs passed.

        A key is a hash of the language and the words.
        """
        seeds = {lang: _seed(lang) for lang in set(self.langs)}
        seed = np.repeat(np.array([seeds[lang] for lang in self.langs], np.uint64), np.diff(self.at))
        count, pairs = len(self.hashes), None
        for n in range(1, min(max(sizes), count) + 1):
            after_pairs = n == 2 and max(sizes) > 2
            if n not in sizes and not after_pairs:
                continue
            keys = mix(ngram_hashes(self.hashes, n) ^ seed[: count - n + 1])
            whole = self.piece[: len(keys)] == self.piece[n - 1 :]
            if after_pairs:
                pairs = whole & told(passed, keys)
            if n > 2:
                whole = np.logical_and.reduce([pairs[i : len(keys) + i] for i in range(n - 1)])
            where = np.flatnonzero(whole)
            if n in sizes and len(where):
                yield n, where, keys[where]

    def spelled(self, word: int, n: int) -> bytes:
        """The n words from a place on, joined by spaces."""
        end = self.starts[word + n] if word + n < len(self.starts) else len(self.data)
        return b" ".join(self.data[self.starts[word] : end].split())


def _seed(lang: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(lang.encode(), seed=11)


def _bits(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a key in the table of survivors."""
    m = np.uint64(FILTER_BITS - 1)
    return keys & m, ((keys >> np.uint64(32)) & m) * np.uint64(0x9E3779B1) & m


def told(table_words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit table holds each key: true for all survivors and for few others."""
    out = np.ones(len(keys), bool)
    for at in _bits(keys):
        out &= (table_words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def slot_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


class Summaries:
    """Misra-Gries summaries of the slots of one task; summaries and plain counts are merged in alike.

    capacity: counters of each slot. A slot that holds more loses the count just beyond its
    capacity from every counter, and those that reach 0; `lost` is what it has lost in all.
    """

    def __init__(self, capacity: np.ndarray) -> None:
        self.capacity, self.lost = capacity, np.zeros(len(capacity), np.int64)
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        keys, counts = added(np.concatenate((self.keys, keys)), np.concatenate((self.counts, counts)))
        slots = slot_of(keys)  # ascending, as keys are
        held = np.bincount(slots, minlength=len(self.capacity))
        taken = np.zeros(len(self.capacity), np.int64)
        begin = np.cumsum(held) - held
        for s in np.flatnonzero(held > self.capacity):
            own = counts[begin[s] : begin[s] + held[s]]
            taken[s] = np.partition(own, held[s] - self.capacity[s] - 1)[held[s] - self.capacity[s] - 1]
        self.lost += taken
        counts = counts - taken[slots]
        self.keys, self.counts = keys[counts > 0], counts[counts > 0]

    def survivors(self, least: int) -> np.ndarray:
        """The keys that may have occurred `least` times."""
        return self.keys[self.counts + self.lost[slot_of(self.keys)] >= least]


def _mass(passed: np.ndarray | None, sizes: range) -> Callable:
    """Words of each language (slot -1), once, and occurrences of each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, words = np.zeros(1 << SLOT_BITS, np.int64), {}
        for batch in slices(batches):
            found = Words(batch)
            if 1 in sizes:
                for lang, n in zip(found.langs, np.diff(found.at).tolist(), strict=True):
                    words[lang] = words.get(lang, 0) + n
            for _, _, keys in found.grams(passed, sizes):
                mass += np.bincount(slot_of(keys), minlength=len(mass))
        slots = np.flatnonzero(mass)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*words, *[None] * len(slots)], pa.string()), pa.array([*[-1] * len(words), *slots.tolist()], pa.int32()), pa.array([*words.values(), *mass[slots].tolist()], pa.int64())],
            ["lang", "slot", "mass"],
        )

    return run


def _posted(passed: np.ndarray | None, sizes: range) -> Callable:
    """(slot, key, n) of a task's n-grams, counted as far as HELD of them fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            keys, counts = added(np.concatenate(held), np.ones(size, np.int64))
            for i in range(0, len(keys), SENT):
                k = keys[i : i + SENT]
                yield pa.RecordBatch.from_arrays([pa.array(slot_of(k).astype(np.int32)), pa.array(k.view(np.int64)), pa.array(counts[i : i + SENT])], ["slot", "key", "n"])

        for batch in slices(batches):
            for _, _, keys in Words(batch).grams(passed, sizes):
                held.append(keys)
                size += len(keys)
            if size >= HELD:
                yield from sent()
                held, size = [], 0
        if size:
            yield from sent()

    return run


def _summarised(capacity: np.ndarray, least: int) -> Callable:
    """The surviving keys of the slots dealt to a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, size = Summaries(capacity), [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= HELD // 3:
                own.merge(*_columns(held))
                held, size = [], 0
        if held:
            own.merge(*_columns(held))
        yield pa.RecordBatch.from_arrays([pa.array(own.survivors(least).view(np.int64))], ["key"])

    return run


def _columns(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([b.column("key").to_numpy() for b in batches]).view(np.uint64), np.concatenate([b.column("n").to_numpy() for b in batches])


def _spelled(passed: np.ndarray, buckets: int) -> Callable:
    """(bucket, lang, keys, phrases, n): what a task has counted of each bucket's phrases that may be survivors, as far as SPELLED of them fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}

        def sent() -> pa.RecordBatch:
            keys = np.fromiter(seen, np.uint64, len(seen))
            langs, phrases, counts = zip(*seen.values(), strict=True)
            coded = pa.array(langs, pa.string()).dictionary_encode()
            group = (keys >> np.uint64(32)) % np.uint64(buckets) * np.uint64(len(coded.dictionary)) + coded.indices.to_numpy().astype(np.uint64)
            order = np.argsort(group, kind="stable")
            first = np.flatnonzero(np.diff(group[order].astype(np.int64), prepend=-1))
            ends = pa.array(np.append(first, len(order)).astype(np.int32))
            group = group[order][first].astype(np.int64)
            took = lambda x: pa.ListArray.from_arrays(ends, x.take(pa.array(order)))
            return pa.RecordBatch.from_arrays(
                [pa.array(group // len(coded.dictionary)), coded.dictionary.take(pa.array(group % len(coded.dictionary))), took(pa.array(keys.view(np.int64))), took(pa.array(phrases, pa.binary()).cast(pa.string())), took(pa.array(counts, pa.int64()))],
                ["bucket", "lang", "keys", "phrases", "n"],
            )

        for batch in slices(batches):
            found = Words(batch)
            for n, where, keys in found.grams(passed, range(1, LONGEST + 1)):
                good = told(passed, keys)
                keys, first, counts = np.unique(keys[good], return_index=True, return_counts=True)
                where = where[good][first]
                docs = np.searchsorted(found.at, where, "right") - 1
                for key, count, w, d in zip(keys.tolist(), counts.tolist(), where.tolist(), docs.tolist(), strict=True):
                    known = seen.get(key)
                    if known:
                        known[2] += count
                    else:
                        seen[key] = [found.langs[d], found.spelled(w, n), count]
            if len(seen) >= SPELLED:
                yield sent()
                seen = {}
        if seen:
            yield sent()

    return run


def _exact(least: int) -> Callable:
    """(lang, phrase, n) with n >= least: of each bucket its survivors come first (lang is null), and the tasks' counts are added to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = counts = langs = phrases = None

        def settled() -> pa.RecordBatch:
            at = np.flatnonzero(counts >= least)
            return pa.RecordBatch.from_arrays([pa.array([langs[i] for i in at], pa.string()), pa.array([phrases[i] for i in at], pa.string()), pa.array(counts[at])], ["lang", "phrase", "n"])

        for batch in batches:
            for i, lang in enumerate(batch.column("lang").to_pylist()):
                own = batch.column("keys")[i].values.to_numpy().view(np.uint64)
                if lang is None:
                    if keys is not None:
                        yield settled()
                    keys = np.sort(own)
                    counts, langs, phrases = np.zeros(len(keys), np.int64), [None] * len(keys), [None] * len(keys)
                    continue
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == own)
                at = at[hit]
                new = np.flatnonzero(counts[at] == 0)
                counts[at] += batch.column("n")[i].values.to_numpy()[hit]
                told_of = batch.column("phrases")[i].values.take(pa.array(hit[new])).to_pylist()
                for k, phrase in zip(at[new].tolist(), told_of, strict=True):
                    langs[k], phrases[k] = lang, phrase
        if keys is not None:
            yield settled()

    return run


def _filter(spark: SparkSession, survivors: DataFrame) -> np.ndarray:
    """The bit table of the survivors: at most FILTER_BITS / 64 words reach the driver, whatever their number."""
    key, m = F.col("key"), FILTER_BITS - 1
    second = (F.shiftrightunsigned(key, 32).bitwiseAND(F.lit(m)) * F.lit(0x9E3779B1)).bitwiseAND(F.lit(m))
    at = survivors.select(F.explode(F.array(key.bitwiseAND(F.lit(m)), second)).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def frequent_phrases(docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """((lang, words, phrase, n) of every phrase of 1 to 5 words with n >= least, (lang, n) words of each language); both stored."""
    spark = docs.sparkSession
    text = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    passed, totals, survivors = None, None, None
    for sizes in (range(1, 3), range(3, LONGEST + 1)):
        mass = materialise(text.mapInArrow(_mass(passed, sizes), "lang string, slot int, mass long").groupBy("lang", "slot").agg(F.sum("mass").alias("mass")), "mass")
        if totals is None:
            totals = mass.where("slot < 0").select("lang", F.col("mass").alias("n"))
        own = mass.where("slot >= 0").select("slot", "mass").toArrow()  # at most 2**SLOT_BITS rows
        capacity = np.ones(1 << SLOT_BITS, np.int64)
        capacity[own.column("slot").to_numpy()] += ROOM * own.column("mass").to_numpy() // least
        posted = text.mapInArrow(_posted(passed, sizes), "slot int, key long, n long").repartition("slot")
        found = materialise(posted.mapInArrow(_summarised(capacity, least), "key long"), "survivors")
        more = _filter(spark, found)
        passed = more if passed is None else passed | more
        survivors = found if survivors is None else survivors.unionByName(found)
    buckets = survivors.count() // BUCKET + 1
    bucket = F.pmod(F.shiftrightunsigned("key", 32), F.lit(buckets))
    first = survivors.groupBy(bucket.alias("bucket")).agg(F.sort_array(F.collect_list("key")).alias("keys"))  # about BUCKET keys, as they are hashes
    counted = text.mapInArrow(_spelled(passed, buckets), "bucket long, lang string, keys array<long>, phrases array<string>, n array<long>")
    dealt = counted.unionByName(first, allowMissingColumns=True).repartition("bucket").sortWithinPartitions("bucket", F.col("lang").asc_nulls_first())
    exact = dealt.mapInArrow(_exact(least), "lang string, phrase string, n long")
    words = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1
    return materialise(exact.select("lang", words.alias("words"), "phrase", "n"), "phrases"), totals


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the `top` phrases of each language."""
    phrases, totals = frequent_phrases(docs, least, text_col, lang_col)
    found = phrases.where("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"))
    head = lambda p, k: F.call_function("substring_index", p, F.lit(" "), k)
    inner = found.where("words > 2").select("lang", F.col("a").alias("same"), F.explode(F.array(head(F.col("phrase"), F.col("words") - 1), head(F.col("phrase"), 1 - F.col("words")))).alias("part")).distinct()
    kept = found.join(inner.withColumnsRenamed({"lang": "in_lang"}), (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("part")) & (F.col("a") == F.col("same")), "left_anti")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = materialise(cuts.select("lang", "phrase", "a", "k", head(F.col("phrase"), F.col("k")).alias("first"), head(F.col("phrase"), F.col("k") - F.col("words")).alias("rest")), "cuts")
    rows = max(1, cuts.count())

    def counted(df: DataFrame, part: str, out: str) -> DataFrame:
        used = cuts.groupBy(F.col("lang").alias("u_lang"), F.col(part).alias("u")).agg(F.count("*").alias(f"{part}_rows"))
        groups = phrases.join(used, (F.col("lang") == F.col("u_lang")) & (F.col("phrase") == F.col("u"))).select("lang", F.col("phrase").alias(part), F.col("n").alias(out), f"{part}_rows")
        return lookup(df, groups, ["lang", part], f"{part}_rows", rows).drop(f"{part}_rows")

    both = counted(counted(cuts, "first", "l"), "rest", "r").join(F.broadcast(totals.withColumnsRenamed({"lang": "t_lang"})), F.col("lang") == F.col("t_lang"))  # one row a language
    big = lambda c: F.col(c).cast("decimal(18,0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * big("a") * big("n"), big("l") * big("r"))
    weakest = both.select("lang", "phrase", "a", "n", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "a", "n").agg(F.min("cut").alias("cut"))
    rated = weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score", (-F.col("cut.score")).alias("falling"), (-F.col("a")).alias("rarer"), F.lit(1).cast("long").alias("one"))
    ranked = running_sums(rated, ["lang"], ["falling", "rarer", "phrase"], ["one"]).where(F.col("before_one") < top)
    return ranked.select("lang", (F.col("before_one") + 1).cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


# A-Z are spelled out, as lower() would change other letters too.
SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
runs AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM spots, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w)),
grams AS (SELECT lang, k, phrase, count(*)::BIGINT AS f FROM runs GROUP BY ALL HAVING count(*) >= 100),
kept AS (SELECT * FROM grams c WHERE k > 1 AND NOT EXISTS (
  SELECT 1 FROM grams x WHERE x.lang = c.lang AND x.k = c.k + 1 AND x.f = c.f AND (starts_with(x.phrase, c.phrase || ' ') OR ends_with(x.phrase, ' ' || c.phrase)))),
cuts AS (SELECT lang, phrase, f AS a, unnest(range(1, k)) AS j, string_split(phrase, ' ') AS w FROM kept),
scored AS (SELECT c.lang, c.phrase, c.a, c.j, x.f AS l, y.f AS r, t.n, (1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : j], ' ') JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1 :], ' ') JOIN totals t ON t.lang = c.lang),
weakest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS place FROM scored),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM weakest WHERE place = 1)
SELECT * FROM ranked WHERE rank <= 2000
"""
