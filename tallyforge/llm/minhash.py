"""Near duplicates by an inverted join of MinHash signature coordinates.

A text's set holds the hashes of its distinct four-word shingles. Its signature has
COORDINATES values, the least of the set under as many hash functions; two sets of
similarity s agree in each coordinate with probability s. Every set is posted under its
(coordinate, value) pairs, and pairs of sets are candidates if they collide in MATCHES
coordinates or more. A pair of similarity 0.8 collides in fewer with probability 4e-6 (0.85:
8e-9), which is what the method can miss; candidates are confirmed on the full sets.

Counting all collisions would merge every posting list. Instead
- prefix: of a pair's MATCHES common lists at least one is left when each set leaves out its
  MATCHES - 1 longest lists (one order of lists for all sets), so only the shorter ones are merged;
- skip: the long lists are never merged. A pair that met in a short one counts all its
  collisions from the two signatures, which travel as 16 bits a coordinate.
Lists of one set are not joined at all; most sets have no others.

The sets of a list are never all paired:
1. a set is compared with central members of all its lists, those with the longest lists
   altogether; it keeps the PIVOTS it meets in most of them. A list is met by its few central
   members alone, so here the long ones count too: a family of edited copies is found by the
   text they come from. Confirmed links give components;
2. then only pairs of one short list that lie in different components are compared. Collisions
   are counted in the join itself, and a parity sketch, whose distance is at most the sets'
   difference, drops most of the others; what is left is confirmed, and the components joined.
Equal sets are one node throughout.

Edge cases: a null or word-free text has an empty set and is linked with nothing. Fewer than
four words are one shingle. Repeated rows and ids: every row is a document of its own; equal
sets are linked. A null id is never the smallest, unless alone. Empty tables give empty
results. Only id and text are read; stay() keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import slices, table, text_bytes
from tallyforge.llm.jaccard import _node as set_id
from tallyforge.llm.jaccard import CARRIED, bits_apart, row_hash, sketch
from tallyforge.llm.words import LOWER, mix, shingle_sets
from tallyforge.plans.graph import connected_components
from tallyforge.plans.rows import drop_rows, small
from tallyforge.plans.scratch import materialise
from tallyforge.plans.skew import explode_copies, lookup

SHINGLE, PERCENT = 4, 80
COORDINATES, MATCHES = 64, 36
PIVOTS = 3
_RNG = np.random.default_rng(64)
_TURN = _RNG.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64)
#: Shingles that are hashed at once under all coordinates.
_BLOCK = 1 << 14


def signature(tokens: np.ndarray) -> np.ndarray:
    """For each coordinate a hash of (coordinate, least value of the set under it)."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(tokens), _BLOCK):
        part = tokens[i : i + _BLOCK]
        for c in range(COORDINATES):
            x = (part ^ _SHIFT[c]) * _TURN[c]
            least[c] = min(least[c], (x ^ (x >> np.uint64(32))).min())
    return mix(least ^ mix(_SHIFT))


def lanes(keys: np.ndarray) -> np.ndarray:
    """16 bits of each coordinate, four to a long."""
    return keys.astype("<u8").view("<u2")[::4].copy().view("<i8")


def folded(bits: np.ndarray) -> np.ndarray:
    """A parity sketch of at most CARRIED longs."""
    while len(bits) > CARRIED:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _near(x: str, y: str, n: str = "n", lanes: str = "lanes", sketch: str = "sketch") -> Column:
    """Whether two sets (the columns n, lanes and sketch with the suffixes x and y) can be similar: by size, by the sketches' distance, by collisions."""
    size = lambda f: f(f"{n}{x}", f"{n}{y}")
    fits = 100 * size(F.least) >= PERCENT * size(F.greatest)
    apart = (100 + PERCENT) * bits_apart(F.col(f"{sketch}{x}"), F.col(f"{sketch}{y}")) <= (100 - PERCENT) * (F.col(f"{n}{x}") + F.col(f"{n}{y}"))
    return fits & apart & (collisions(F.col(f"{lanes}{x}"), F.col(f"{lanes}{y}")) >= MATCHES)


def collisions(x: Column, y: Column) -> Column:
    """Coordinates in which two signatures (lanes) agree."""
    def apart(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        for shift in (8, 4, 2, 1):  # then a lane's lowest bit is set if any of its bits was
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift))
        return F.bit_count(d.bitwiseAND(F.lit(0x0001000100010001)))

    return F.lit(COORDINATES) - F.aggregate(F.zip_with(x, y, apart), F.lit(0), lambda s, n: s + n)


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    return shingle_sets([t.translate(LOWER) for t in texts], SHINGLE)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row's set by its size and id; the signature with the first row of a set in a task."""
    seen: set[int] = set()
    for batch in slices(batches, limit=1_000_000):
        n, node, keys, packed, bits = [], [], [], [], []
        for s in _sets(text_bytes(batch.column("text"))):
            own = set_id(s) if len(s) else None
            new = own is not None and own not in seen
            sig = signature(s) if new else None
            if new:
                seen.add(own)
            n.append(len(s))
            node.append(own)
            keys.append(sig.view(np.int64) if new else None)
            packed.append(lanes(sig) if new else None)
            bits.append(folded(sketch(s)) if new else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row_hash"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(packed, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
            ["doc_id", "row_hash", "n", "node", "keys", "lanes", "sketch"],
        )


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the rows (a, b, x, y) whose texts x and y are similar; equal neighbours in y are hashed once."""
    last, y = None, None
    for batch in slices(batches, text="x", limit=1_000_000):
        other, good = text_bytes(batch.column("y")), []
        for i, x in enumerate(_sets(text_bytes(batch.column("x")))):
            if other[i] != last:
                last, y = other[i], _sets([other[i]])[0]
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(good))


class CoordinateJoin:
    """Near-duplicate links and components of a table of documents."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        self.hashed = text.withColumn("row_hash", row_hash(F.col("doc_id"), F.col("text")))
        kind = docs.schema[id_col].dataType.simpleString()
        signed = materialise(self.hashed.mapInArrow(_signed, f"doc_id {kind}, row_hash long, n long, node long, keys array<long>, lanes array<long>, sketch array<long>"), "signed")
        self.slim = signed.select("doc_id", "row_hash", "n", "node")
        groups = signed.where("n > 0").groupBy("node").agg(
            F.min("doc_id").alias("rep"), F.count("*").alias("group_size"), F.first("n").alias("n"), *(F.first(c, ignorenulls=True).alias(c) for c in ("keys", "lanes", "sketch")),
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash")).alias("first_row"),
        )
        self.nodes = materialise(groups, "nodes")
        self.labels = self._labels()

    def _labels(self) -> DataFrame:
        """(node, label) of the nodes that have links to other nodes."""
        lists = self._lists()
        first = self._links(self._pivot_pairs(lists))
        labels = materialise(connected_components(first), "labels")
        second = self._links(self._across(lists.where("short"), labels))
        if second.isEmpty():
            return labels
        return materialise(connected_components(first.unionByName(second)), "labels")

    def _lists(self) -> DataFrame:
        """(key, node, weight, short): the lists of each node that hold others too; short: it is none of the node's MATCHES - 1 longest.

        weight tells how central a node is: the longer its lists, the more sets are like it.
        Nodes with fewer than MATCHES such lists have no candidates and are left out.
        """
        posted = self.nodes.select(F.explode("keys").alias("key"), "node")
        sizes = materialise(posted.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "lists")
        total = max(1, self.nodes.count() * COORDINATES)
        shared = lookup(posted, sizes, ["key"], "size", total).where("size is not null")
        own = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("size", "key")), asc=False).alias("lists"), F.sum(F.log("size")).alias("weight"))  # COORDINATES lists a node at most
        kept = own.where(F.size("lists") >= MATCHES).select("node", "weight", F.posexplode("lists").alias("place", "list"))
        return materialise(kept.select(F.col("list.key").alias("key"), "node", "weight", (F.col("place") >= MATCHES - 1).alias("short")), "lists")

    def _pivot_pairs(self, lists: DataFrame) -> DataFrame:
        """(a, b): each node with up to PIVOTS central nodes of its lists, those that it meets in most of them."""

        def central(i: int) -> Column:
            luck = 1 + F.pmod(F.xxhash64("node", F.lit(i)), F.lit(1000)) / 4000 if i else F.lit(1.0)
            return F.max_by("node", F.struct(F.col("weight") * luck, "node"))

        groups = lists.groupBy("key").agg(F.count("*").alias("size"), *(central(i).alias(f"p{i}") for i in range(PIVOTS)))
        groups = materialise(groups.select("key", "size", F.array_distinct(F.array(*(F.col(f"p{i}") for i in range(PIVOTS)))).alias("pivots")), "pivots")
        told = lookup(lists.select("key", "node"), groups, ["key"], "size", max(1, lists.count()))
        each = told.select("node", F.explode("pivots").alias("pivot")).where("node <> pivot").groupBy("node", "pivot").agg(F.count("*").alias("met"))
        best = each.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("met", "pivot")), asc=False), 1, PIVOTS).alias("best"))  # PIVOTS a list at most
        pairs = best.select("node", F.explode("best.pivot").alias("pivot"))
        return pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()

    def _across(self, short: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs (a, b), a < b, of one list and of different components."""
        label = small(labels.select(F.col("node").alias("l_node"), F.col("component").alias("label")))
        told = short.select("key", "node").join(label, F.col("node") == F.col("l_node"), "left").drop("l_node").withColumn("label", F.coalesce("label", "node"))
        told = materialise(told, "labelled")
        mixed = told.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select(F.col("key").alias("m_key"))
        facts = self.nodes.select(F.col("node").alias("f_node"), "n", "lanes", "sketch")
        still = materialise(told.join(mixed, F.col("key") == F.col("m_key"), "left_semi"), "open")
        own = still.groupBy(F.col("node").alias("o_node")).agg(F.collect_list("key").alias("keys"))  # COORDINATES at most
        rows = materialise(still.join(facts, F.col("node") == F.col("f_node")).join(own, F.col("node") == F.col("o_node")).drop("f_node", "o_node"), "sided")
        side = lambda i: rows.select(F.col("key").alias(f"k{i}"), *(F.col(c).alias(f"{c}{i}") for c in ("node", "label", "n", "lanes", "sketch", "keys")))
        once = F.array_min(F.array_intersect("keys1", "keys2")) == F.col("k1")  # a pair is made in the first of its common lists
        met = side(1).join(side(2), (F.col("k1") == F.col("k2")) & (F.col("node1") < F.col("node2")) & (F.col("label1") != F.col("label2")) & _near("1", "2") & once)
        return met.select(F.col("node1").alias("a"), F.col("node2").alias("b"))

    def _links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that collide often enough and whose full sets are similar; stored."""
        facts = lambda i: self.nodes.select(F.col("node").alias(f"node{i}"), *(F.col(c).alias(f"{c}{i}") for c in ("n", "lanes", "sketch")), F.col("first_row").alias(f"row{i}"))
        near = materialise(pairs, "pairs").join(facts(1), F.col("a") == F.col("node1")).join(facts(2), F.col("b") == F.col("node2")).where(_near("1", "2"))
        near = materialise(near.select("a", "b", "row1", "row2"), "near")
        here = lambda r: (F.col("row_hash") == F.col(f"{r}.row_hash")) & F.col("doc_id").eqNullSafe(F.col(f"{r}.doc_id"))
        once = materialise(near.select(F.col("b").alias("b2"), "row2").distinct(), "seconds")
        x = self.hashed.join(small(near.select("a", "b", "row1")), here("row1")).select("a", "b", F.col("text").alias("x"))
        y = self.hashed.join(small(once), here("row2")).select("b2", F.col("text").alias("y"))
        met = x.join(y, F.col("b") == F.col("b2")).select("a", "b", "x", "y")
        return materialise(met.mapInArrow(_confirmed, "a long, b long"), "links")

    def components(self) -> DataFrame:
        """One row per document, equal rows as `copies`: doc_id, row_hash, n_shingles, component_id, and its component's first row."""
        keyed = self.nodes.select(F.col("node").alias("k"), "rep", "group_size", "first_row")
        keyed = keyed.join(self.labels.select(F.col("node").alias("l"), "component"), F.col("k") == F.col("l"), "left").withColumn("label", F.coalesce("component", "k"))
        least = keyed.groupBy("label").agg(F.min("rep").alias("component_id"), F.min("first_row").alias("stays")).withColumnRenamed("label", "least_of")
        full = materialise(keyed.join(least, F.col("label") == F.col("least_of")).select(F.col("k").alias("node"), "group_size", "component_id", "stays"), "components")
        rows = self.slim.groupBy("doc_id", "row_hash", "n", "node").agg(F.count("*").alias("copies"))
        told = lookup(rows, full, ["node"], "group_size", max(1, self.slim.count()))
        return told.select("doc_id", "row_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "stays", "copies")


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    found = CoordinateJoin(table(spark, sf_dir, "documents")).components()
    each = explode_copies(found, "copies", "copy")
    return each.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def stay(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all columns: of each component the one with the smallest id; all without words."""
    found = CoordinateJoin(docs, id_col, text_col).components()
    own = F.col("stays.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("stays.row_hash") == F.col("row_hash"))
    rows = materialise(found.where("n_shingles > 0").select(F.col("doc_id").alias("id"), F.col("row_hash").alias("mark"), own.alias("kept"), "copies"), "decided")
    return drop_rows(docs, id_col, row_hash(F.col(id_col), F.col(text_col).cast("string")), rows.where("not kept"), rows.where("kept and copies > 1"))
