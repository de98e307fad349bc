"""N-gram Jaccard join by parity sketches.

A document's set holds the hashes of its distinct five-word shingles. XOR-ing tokens into
a bit sketch keeps the parity of each bit, so the XOR of two sketches is the sketch of
their symmetric difference and its weight (the Hamming distance) is at most the size of
that difference. Two sets with 100 |A n B| >= 75 |A u B| differ in at most
d = (|A| + |B|) / 7 tokens.

Candidates come from a pigeonhole join. Sets are put into size bands; in band k the token
space is cut into P parts, P > d, and each part of a set is XOR-ed to one 64-bit sketch
word. At most d parts can differ, so a similar pair agrees in some part. A set speaks in
its own band, and in the next one if a partner can be there. Parts without tokens say
nothing and are left out; a set that then has too few parts left (its `slack`, parts
beyond d + 1, is negative) adds its empty parts, so no pair is lost.

Sets that share a part meet in a key group, whose pairs are never all made:
1. each set is compared with PIVOTS central members of its key groups, those that it
   shares most tokens with; verified links give components. Central members are those
   whose parts most others have, so a family of edited copies gathers around them;
2. only pairs of one key group that are in different components remain. Of these, a
   similar pair agrees in more than `slack` parts, so each set leaves out its `slack` most
   frequent parts (the order is the same for all sets): by the prefix principle the pair
   still meets in one of the others. Sizes and sketches are compared in the join itself.
Parts that agree hold equal tokens, so their token counts bound the intersection from
below; a pair that this bound proves is a link at once. A full-width sketch drops most of
the others before verification, which brings the two texts together and intersects their sets.

Links are exact up to collisions of 64-bit hashes. Equal sets are one node throughout.

Edge cases: a null or word-free text has an empty set and is linked with nothing. Fewer
than five words are one shingle. Repeated rows and ids: every row is a document of its
own; equal sets are linked. A null id is never the smallest, unless alone. Empty tables
give empty results. Only id and text are read; stay() keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import slices, table, text_bytes
from tallyforge.llm.words import LOWER, mix, shingle_sets
from tallyforge.plans.graph import connected_components
from tallyforge.plans.rows import drop_rows, small
from tallyforge.plans.scratch import materialise
from tallyforge.plans.skew import explode_copies, lookup

#: A sketch has the power of two from this many bits a token on: unrelated sets then differ in far more bits than d.
BITS_PER_TOKEN = 2
BAND_GROWTH = 1.8
PIVOTS = 3
#: Longs of a sketch that travel with a key: wider sketches are folded to this width.
CARRIED = 16

_BANDS = [1]
while _BANDS[-1] < 2**40:
    _BANDS.append(max(_BANDS[-1], int(_BANDS[-1] * BAND_GROWTH)) + 1)
_LOWEST = np.array(_BANDS)


def parts_of(band: int) -> int:
    """Parts of the token space in a band: more than the largest difference there, and some to spare for empty parts."""
    d = 2 * (int(_LOWEST[band + 1]) - 1) // 7
    return d + 1 + int(np.ceil(0.06 * d + 1.5 * np.sqrt(d + 1)))


def part_words(tokens: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(band, slack, keys, tokens in each part) for each band in which a sorted set of tokens can have a partner of another set."""
    n = len(tokens)
    own = int(np.searchsorted(_LOWEST, n, "right")) - 1
    for band in (own, own + 1):
        low, high = int(_LOWEST[band]), int(_LOWEST[band + 1]) - 1
        largest = min(high, 4 * n // 3)
        d = (n + largest) // 7
        if largest < low or d == 0:
            continue
        parts = parts_of(band)
        part = ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        word = np.bitwise_xor.reduceat(tokens, first)
        at = part[first]
        held = np.diff(np.append(first, n))
        slack = len(first) - d - 1
        if slack < 0:
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), at)
            at, word, held = np.concatenate((at, empty)), np.concatenate((word, np.zeros(len(empty), np.uint64))), np.append(held, np.zeros(len(empty), np.int64))
        yield band, slack, mix(word ^ mix(at + np.uint64(band << 40))), held


def sketch(tokens: np.ndarray) -> np.ndarray:
    """The parity sketch of a set: bit h mod width is the parity of the tokens that fall there.

    Half of a sketch XOR-ed to the other half is the sketch of half the width.
    """
    bits = max(256, 1 << int(BITS_PER_TOKEN * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _halved(s: Column) -> Column:
    half = (F.size(s) / 2).cast("int")
    return F.zip_with(F.slice(s, F.lit(1), half), F.slice(s, half + 1, half), lambda a, b: a.bitwiseXOR(b))


def folded_to(s: Column, longs: int) -> Column:
    """A sketch of at most `longs` longs: the XOR of its equal pieces."""
    pieces = F.transform(F.sequence(F.lit(1), F.size(s), F.lit(longs)), lambda i: F.slice(s, i, F.lit(longs)))
    return F.when(F.size(s) <= longs, s).otherwise(F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), F.element_at(pieces, 1), lambda a, b: F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))))


def bits_apart(x: Column, y: Column) -> Column:
    """Hamming distance of two sketches, the wider one folded if their widths differ (by two at most)."""

    def folded(s: Column, other: Column) -> Column:
        return F.when(F.size(s) > F.size(other), _halved(s)).otherwise(s)

    return F.aggregate(F.zip_with(folded(x, y), folded(y, x), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, n: s + n)


def _node(tokens: np.ndarray) -> int:
    """64 bits that identify a set."""
    n = np.array([len(tokens)], np.uint64)
    both = np.bitwise_xor.reduce(mix(tokens), keepdims=True) + tokens.sum(dtype=np.uint64, keepdims=True) * n
    return int(mix(both + n).view(np.int64)[0])


def _sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    return shingle_sets([t.translate(LOWER) for t in text_bytes(batch.column("text"))])


def _slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=1_000_000):
        sets = _sets(batch)
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("row_hash"), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([_node(s) if len(s) else None for s in sets], pa.int64()),
            pa.array([sketch(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
        ], ["doc_id", "row_hash", "n", "node", "sketch"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of each set once a task, so a text with many copies brings as many rows a part as there are tasks at most."""
    seen: set[int] = set()
    for batch in slices(batches, limit=1_000_000):
        key, node, band, slack, size, tokens = [], [], [], [], [], []
        for s in _sets(batch):
            own = _node(s) if len(s) else None
            if own is not None and own not in seen:
                seen.add(own)
                for b, k, words, held in part_words(s):
                    key.append(words)
                    tokens.append(held)
                    node.append(own)
                    band.append(b)
                    slack.append(k)
                    size.append(len(words))
        if key:
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(key).view(np.int64)), pa.array(np.repeat(np.array(node, np.int64), size)),
                pa.array(np.repeat(np.array(band, np.int16), size)), pa.array(np.repeat(np.array(slack, np.int32), size)),
                pa.array(np.concatenate(tokens).astype(np.int32)),
            ], ["key", "node", "band", "slack", "tokens"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the rows (a, b, x, y) whose texts x and y are similar; equal neighbours in y are hashed once."""
    last, y = None, None
    for batch in slices(batches, text="x", limit=1_000_000):
        other, good = text_bytes(batch.column("y")), []
        for i, x in enumerate(shingle_sets([t.translate(LOWER) for t in text_bytes(batch.column("x"))])):
            if other[i] != last:
                last, y = other[i], shingle_sets([other[i].translate(LOWER)])[0]
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(100 * both >= 75 * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(good))


def _similar(n: Column, m: Column, both: Column, percent: int = 75) -> Column:
    return 100 * both >= percent * (n + m - both)


class ParityJoin:
    """Near-duplicate links and components of a table of documents."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        self.text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        hashed = self.text.withColumn("row_hash", row_hash(F.col("doc_id"), F.col("text")))
        kind = docs.schema[id_col].dataType.simpleString()
        self.slim = materialise(hashed.mapInArrow(_slim, f"doc_id {kind}, row_hash long, n long, node long, sketch array<long>"), "sets")
        groups = self.slim.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("group_size"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash")).alias("first_row"))
        self.nodes = materialise(groups, "nodes")
        self.labels = self._labels()

    def _labels(self) -> DataFrame:
        """(node, label) of the nodes that have links to other nodes."""
        shared = self._shared_keys()
        best = self._pivot_pairs(shared)
        first = materialise(self._verified(materialise(best, "pairs")), "links")
        labels = materialise(connected_components(first), "labels")
        rest = materialise(self._across(shared, labels), "pairs")
        second = materialise(self._verified(rest), "links")
        if second.isEmpty():
            return labels
        return materialise(connected_components(first.unionByName(second)), "labels")

    def _shared_keys(self) -> DataFrame:
        """(key, node, band, slack, tokens, members) of the key groups that hold more than one node."""
        keys = self.text.select("text").mapInArrow(_keys, "key long, node long, band short, slack int, tokens int")
        group = Window.partitionBy("key")
        met = keys.select("*", F.min("node").over(group).alias("least"), F.max("node").over(group).alias("most"), F.count("*").over(group).alias("members"))
        return materialise(met.where("least <> most").drop("least", "most").distinct(), "keys")

    def _pivot_pairs(self, shared: DataFrame) -> DataFrame:
        """(a, b, common): each node with up to PIVOTS central nodes of its key groups, by common tokens."""
        weight = shared.groupBy("node").agg(F.sum(F.log("members")).alias("weight")).select(F.col("node").alias("w_node"), "weight")
        weighed = materialise(shared.select("key", "node", "band", "tokens").join(small(materialise(weight, "weights")), F.col("node") == F.col("w_node")).drop("w_node"), "weighed")

        def central(i: int) -> Column:
            luck = 1 + F.pmod(F.xxhash64("node", F.lit(i)), F.lit(1000)) / 4000 if i else F.lit(1.0)
            return F.max_by("node", F.col("weight") * luck)

        groups = weighed.groupBy("key").agg(F.count("*").alias("group_size"), *(central(i).alias(f"p{i}") for i in range(PIVOTS)))
        groups = materialise(groups.select("key", "group_size", F.array_distinct(F.array(*(F.col(f"p{i}") for i in range(PIVOTS)))).alias("pivots")), "pivots")
        told = lookup(weighed.drop("weight"), groups, ["key"], "group_size", max(1, weighed.count()))
        each = told.select("node", "band", "tokens", F.explode("pivots").alias("pivot")).where("node <> pivot")
        common = each.groupBy("node", "pivot", "band").agg(F.sum("tokens").alias("common")).groupBy("node", "pivot").agg(F.max("common").alias("common"))
        rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("common"), "pivot"))
        pairs = common.withColumn("rank", rank).where(F.col("rank") <= PIVOTS)
        return pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"), "common").groupBy("a", "b").agg(F.max("common").alias("common"))

    def _across(self, shared: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs (a, b, common), a < b, that may be links between different components."""
        label = small(labels.select(F.col("node").alias("l_node"), F.col("component").alias("label")))
        told = shared.select("key", "node", "band", "slack", "members").join(label, F.col("node") == F.col("l_node"), "left").drop("l_node").withColumn("label", F.coalesce("label", "node"))
        mixed = told.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select(F.col("key").alias("m_key"))
        open_rows = materialise(told.join(mixed, F.col("key") == F.col("m_key"), "left_semi"), "open")
        frequent = F.row_number().over(Window.partitionBy("node", "band").orderBy(F.desc("members"), "key"))
        rare = open_rows.withColumn("rank", frequent).where(F.col("rank") > F.greatest("slack", F.lit(0))).select("key", "node", "label")
        facts = self.nodes.select(F.col("node").alias("f_node"), "n", folded_to(F.col("sketch"), CARRIED).alias("sketch"))
        rows = materialise(rare.join(facts, F.col("node") == F.col("f_node")).drop("f_node"), "rare")
        side = lambda i: rows.select(F.col("key").alias(f"k{i}"), F.col("node").alias(f"node{i}"), F.col("label").alias(f"label{i}"), F.col("n").alias(f"n{i}"), F.col("sketch").alias(f"sk{i}"))
        sizes = 100 * F.least("n1", "n2") >= 75 * F.greatest("n1", "n2")
        close = 7 * bits_apart(F.col("sk1"), F.col("sk2")) <= F.col("n1") + F.col("n2")
        met = side(1).join(side(2), (F.col("k1") == F.col("k2")) & (F.col("node1") < F.col("node2")) & (F.col("label1") != F.col("label2")) & sizes & close)
        return met.select(F.col("node1").alias("a"), F.col("node2").alias("b"), F.lit(0).cast("long").alias("common")).distinct()

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, common) that are links; common: a lower bound of the intersection."""
        facts = self.nodes.select("node", "n", "sketch")
        a = facts.select(F.col("node").alias("na"), F.col("n").alias("n_a"), F.col("sketch").alias("sk_a"))
        b = facts.select(F.col("node").alias("nb"), F.col("n").alias("n_b"), F.col("sketch").alias("sk_b"))
        near = pairs.join(a, F.col("a") == F.col("na")).join(b, F.col("b") == F.col("nb"))
        near = near.where(100 * F.least("n_a", "n_b") >= 75 * F.greatest("n_a", "n_b"))
        near = near.where(7 * bits_apart(F.col("sk_a"), F.col("sk_b")) <= F.col("n_a") + F.col("n_b"))
        near = materialise(near.select("a", "b", _similar(F.col("n_a"), F.col("n_b"), F.col("common")).alias("proven")), "near")
        open_pairs = near.where("not proven")
        row = self.nodes.select(F.col("node").alias("k"), F.col("first_row.doc_id").alias("r_id"), F.col("first_row.row_hash").alias("r_hash"))
        left = materialise(open_pairs.join(row, F.col("a") == F.col("k")).select("a", "b", "r_id", "r_hash"), "left")
        right = materialise(row.join(open_pairs.select("b").distinct(), F.col("k") == F.col("b")).select("b", "r_id", "r_hash"), "right")
        hashed = self.text.withColumn("row_hash", row_hash(F.col("doc_id"), F.col("text")))
        here = (F.col("row_hash") == F.col("r_hash")) & F.col("doc_id").eqNullSafe(F.col("r_id"))
        x = hashed.join(small(left), here).select("a", "b", F.col("text").alias("x"))
        y = hashed.join(small(right), here).select(F.col("b").alias("yb"), F.col("text").alias("y"))
        met = x.join(y, F.col("b") == F.col("yb")).select("a", "b", "x", "y")
        return near.where("proven").select("a", "b").unionByName(met.mapInArrow(_linked, "a long, b long"))

    def components(self) -> DataFrame:
        """One row per document: doc_id, row_hash, n_shingles, component_id, and its component's first row."""
        label = F.coalesce("component", "k")
        keyed = self.nodes.select(F.col("node").alias("k"), "rep", "group_size", "first_row")
        keyed = keyed.join(self.labels.select(F.col("node").alias("l"), "component"), F.col("k") == F.col("l"), "left").withColumn("label", label)
        least = keyed.groupBy("label").agg(F.min("rep").alias("component_id"), F.min("first_row").alias("stays")).withColumnRenamed("label", "least_of")
        full = materialise(keyed.join(least, F.col("label") == F.col("least_of")).select(F.col("k").alias("node"), "group_size", "component_id", "stays"), "components")
        rows = self.slim.select("doc_id", "row_hash", "n", "node")
        total = max(1, rows.count())
        told = lookup(rows.groupBy("doc_id", "row_hash", "n", "node").agg(F.count("*").alias("copies")), full, ["node"], "group_size", total)
        return told.select("doc_id", "row_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "stays", "copies")


def row_hash(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text, F.lit("row"))


def op8_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    found = ParityJoin(table(spark, sf_dir, "documents")).components()
    return explode_copies(found, "copies", "copy").select("doc_id", "n_shingles", "component_id")


def stay(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all columns: of each component the one with the smallest id; all without words."""
    found = ParityJoin(docs, id_col, text_col).components()
    own = F.col("stays.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("stays.row_hash") == F.col("row_hash"))
    rows = materialise(found.where("n_shingles > 0").select(F.col("doc_id").alias("id"), F.col("row_hash").alias("mark"), own.alias("kept"), "copies"), "decided")
    return drop_rows(docs, id_col, row_hash(F.col(id_col), F.col(text_col).cast("string")), rows.where("not kept"), rows.where("kept and copies > 1"))
