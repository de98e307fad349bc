"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are compared in lower case (A-Z) and without ASCII punctuation. A passage qualifies
if its local alignment with the item (match +1, mismatch and gap -1) scores at least half
the item's m words: a whole copy in which a quarter of the words were replaced, or half of
the item word for word. `similarity` is (score + m) / 2m, so the limit is 0.75, and a copy
with e replaced words has 1 - e / m.

Seeds are SEED-word n-grams of the item, and leave out no passage that qualifies. Its
alignment has M matches and E edits, whether words are replaced, left out or put in, with
M - E >= m / 2. The matches form at most E + 1 runs, and a run of L words holds L - 1 pairs,
so M - E - 1 >= m / 2 - 1 of the item's pairs are left, on diagonals that lie no more than
m / 2 apart. (Runs of three words can be missing altogether: put in a word after every
second one.) Counts over the whole corpus are taken in a first pass: up to half of these
pairs' number are not used as seeds, the most frequent ones first, and the number of seeds
that a passage needs falls by one for each, so no count is too high to be found. What has
the seeds is aligned.

The items are the stated query set: they are broadcast in blocks of at most BLOCK_BYTES of
text, and the corpus is walked once a block, in one narrow pass without a shuffle.

Edge cases: null and empty texts match nothing. Items with null text or fewer than MIN_WORDS
words match nothing. Repeated rows and ids are reported each on their own; repeated items
each match. Empty tables give no rows. Other columns are not read; stay() keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import slices, table, text_bytes
from tallyforge.llm.words import LOWER, ngram_hashes, word_hashes
from tallyforge.plans.rows import drop_rows
from tallyforge.plans.scratch import materialise

SEED = 2
MIN_WORDS = 3
BLOCK_BYTES = 16_000_000
SIMILARITY = 0.75
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def normalised(texts: list[bytes]) -> list[bytes]:
    return [t.translate(LOWER, _PUNCTUATION) for t in texts]


class Items:
    """Word hashes and n-grams of one block of test items; seeds once the corpus counts are known."""

    def __init__(self, ids: list, texts: list[str]):
        words, at = word_hashes(normalised([t.encode() for t in texts]))
        whole = [(i, words[a:b]) for i, a, b in zip(ids, at[:-1], at[1:], strict=True) if b - a >= MIN_WORDS]
        self.ids, self.words = [i for i, _ in whole], [w for _, w in whole]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        grams = [ngram_hashes(w, SEED) for w in self.words]
        self.gram = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        self.place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        self._index()

    def _index(self) -> None:
        order = np.argsort(self.gram, kind="stable")
        self.gram, self.item, self.place = self.gram[order], self.item[order], self.place[order]
        self.keys, self.first = np.unique(self.gram, return_index=True)
        self.count = np.diff(np.append(self.first, len(self.gram)))

    def seed(self, counts: np.ndarray) -> None:
        """Keep the rarer n-grams; counts: corpus occurrences of each of self.keys."""
        seen = np.repeat(counts, self.count)
        pairs = np.maximum(1, (self.sizes + 1) // 2 - 1)  # those that a passage which qualifies is left with
        order = np.lexsort((self.place, -seen, self.item))
        grams = self.sizes - SEED + 1
        rank = np.arange(len(order)) - np.repeat(np.cumsum(grams) - grams, grams)
        rare = np.ones(len(order), bool)
        rare[order] = rank >= (pairs // 2)[self.item[order]]
        self.need = pairs - pairs // 2
        self.gram, self.item, self.place = self.gram[rare], self.item[rare], self.place[rare]
        self._index()

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of grams that are keys, their key numbers)."""
        if not len(self.keys) or not len(grams):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        k = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        at = np.flatnonzero(self.keys[k] == grams)
        return at, k[at]


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """(best local alignment score, end of it in the window); match +1, mismatch and gap -1."""
    steps = np.arange(len(window) + 1)
    row, best, end = np.zeros(len(window) + 1, np.int64), 0, 0
    for word in item:
        new = np.maximum(row - 1, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(window == word, 1, -1))
        row = np.maximum.accumulate(new + steps) - steps
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def matches(texts: list[bytes], items: Items, similarity: float = SIMILARITY) -> list[tuple[int, int, float, int]]:
    """(text index, item index, similarity, word at which the passage ends) of every pair that qualifies."""
    words, at = word_hashes(normalised(texts))
    pos, key = items.find(ngram_hashes(words, SEED))
    text = np.searchsorted(at, pos, "right") - 1
    inside = pos + SEED <= at[text + 1]
    pos, key, text = pos[inside], key[inside], text[inside]
    n = items.count[key]
    entry = np.repeat(items.first[key] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    item, start, text = items.item[entry], np.repeat(pos, n) - items.place[entry], np.repeat(text, n)
    order = np.lexsort((start, item, text))
    item, start, text = item[order], start[order], text[order]
    # a place counts if, with the seeds after it, it has enough of them on diagonals that one alignment can reach
    last = np.arange(len(item)) + items.need[item] - 1
    fits = np.flatnonzero(last < len(item))
    last, reach = last[fits], items.sizes[item[fits]] // 2
    fits = fits[(item[last] == item[fits]) & (text[last] == text[fits]) & (start[last] - start[fits] <= reach)]
    item, start, text = item[fits], start[fits], text[fits]
    if not len(item):
        return []
    heads = np.flatnonzero(np.concatenate(([True], (item[1:] != item[:-1]) | (text[1:] != text[:-1]))))
    out = []
    for a, b in zip(heads, [*heads[1:], len(item)], strict=True):
        i, t = int(item[a]), int(text[a])
        query, low, high = items.words[i], int(at[t]), int(at[t + 1])
        m = len(query)
        starts = start[a:b]
        best, end = 0, 0
        for group in np.split(starts, np.flatnonzero(np.diff(starts) > 2 * m) + 1):
            left = max(low, int(group[0]) - m // 2 - 1)
            score, e = align(query, words[left : min(high, int(group[-1]) + m + m // 2 + 1)])
            if score > best:
                best, end = score, left + e - low
        if (best + m) / (2 * m) >= similarity:
            out.append((t, i, (best + m) / (2 * m), end))
    return out


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """The items in blocks of at most BLOCK_BYTES of text (or one longer item), streamed from the cluster."""
    ids, texts, held = [], [], 0
    for row in benchmark.where(F.col(text_col).isNotNull()).select(id_col, text_col).toLocalIterator():
        if texts and held + len(row[1]) > BLOCK_BYTES:
            yield Items(ids, texts)
            ids, texts, held = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        held += len(row[1])
    yield Items(ids, texts)


def corpus_counts(docs: DataFrame, items: Items) -> np.ndarray:
    """Occurrences in the whole corpus of each n-gram of the block."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value.keys), np.int64)
        for batch in slices(batches, limit=1_000_000):
            words, _ = word_hashes(normalised(text_bytes(batch.column("text"))))
            _, key = shared.value.find(ngram_hashes(words, SEED))
            total += np.bincount(key, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["k", "n"])

    out = np.zeros(len(items.keys), np.int64)
    rows = docs.select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    for r in rows.toLocalIterator():  # at most one row an n-gram of the block
        out[r["k"]] = r["n"]
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, row_hash, item_id, similarity, end_word for each document and item that qualify."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    found = None
    for items in blocks(benchmark, item_col, item_text):
        items.seed(corpus_counts(own, items))
        part = _pass(own, items, f"doc_id {kind}, row_hash long, item_id {item_kind}, similarity double, end_word long", benchmark.schema[item_col].dataType)
        found = part if found is None else found.unionByName(part)
    return found


def _pass(own: DataFrame, items: Items, schema: str, item_type) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    shared, ids = own.sparkSession.sparkContext.broadcast(items), to_arrow_type(item_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1_000_000):
            hits = matches(text_bytes(batch.column("text")), shared.value)
            if hits:
                took = pa.array([h[0] for h in hits])
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(took), batch.column("row_hash").take(took), pa.array([shared.value.ids[h[1]] for h in hits], ids),
                    pa.array([h[2] for h in hits]), pa.array([h[3] for h in hits], pa.int64()),
                ], ["doc_id", "row_hash", "item_id", "similarity", "end_word"])

    return own.select("doc_id", F.xxhash64("doc_id", "text").alias("row_hash"), "text").mapInArrow(run, schema)


def op5_seed_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak of a benchmark item into a document: doc_id, item_id, similarity, end_word."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "end_word")


def stay(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark item, with all columns."""
    gone = materialise(contaminated(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("id"), F.col("row_hash").alias("mark")).distinct(), "leaks")
    return drop_rows(docs, id_col, F.xxhash64(F.col(id_col), F.col(text_col).cast("string")), gone, gone.limit(0))
