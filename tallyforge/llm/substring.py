"""Repeated passages by content-defined chunking.

A gear hash rolls over the bytes of a text: each byte value has a random 64-bit number,
and the hash at a byte is the sum of the numbers of the WINDOW bytes up to it, each
shifted by its distance. A chunk ends where the hash is below 2**64 / MEAN_CHUNK, at most
MAX_CHUNK bytes after the last end, and never inside a character. Ends depend on the
WINDOW bytes before them and on nothing else (there is no least size, which would carry
one end's place over to the next), so a passage has the same chunks wherever it stands,
and an insertion changes only the chunk around it.

Chunks are grouped by a 64-bit digest. A chunk that more than one document has belongs to
the smallest doc_id; in the others it is a repeat. Repeats that follow one another without
a gap form a run. A run of at least MIN_WORDS words is a repeated passage. A passage that long
can keep fewer words in whole chunks, so a run of at least LOW_WORDS is looked at closer: from
its rarest and from its longest chunk on, its text and REACH bytes on both sides are compared
with those around the same chunk in the chunk's owner, and it is a repeated passage if what
agrees has MIN_WORDS whole words.

Digest groups are counted with map-side combine, and looked up with the hot ones
broadcast, so a chunk that a third of all documents hold gathers nowhere.

Edge cases: null and empty texts have no chunks. Rows with equal ids are one document:
what they share with each other is no repeat. Equal rows get equal results. A null id is
no document's owner, and all its shared chunks are repeats. Empty tables give no rows.
Spans are byte offsets in the UTF-8 text; they end at chunk ends, or at words where a run was
looked at closer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import slices, table, text_bytes
from tallyforge.llm.words import mix
from tallyforge.plans.rows import small
from tallyforge.plans.scratch import materialise
from tallyforge.plans.skew import lookup

WINDOW = 8
MEAN_CHUNK, MAX_CHUNK = 20, 256
MIN_WORDS = 50
#: Words in whole chunks from which a run is compared with its owner's copy, and bytes compared on each side; a chunk has MAX_CHUNK at most.
LOW_WORDS, REACH = 12, 256
#: Bytes of one text that are walked at once.
BLOCK = 1_000_000
_GEAR = np.random.default_rng(19700101).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_IS_GAP = np.zeros(256, bool)
_IS_GAP[[9, 10, 11, 12, 13, 32]] = True


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte over the WINDOW bytes up to it, by doubling."""
    h, span = _GEAR[data], 1
    while span < WINDOW:
        longer = h.copy()
        longer[span:] += h[:-span] << np.uint64(span)
        h, span = longer, span * 2
    return h


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of one text; the last is its length."""
    n, candidates = len(data), []
    for at in range(0, n, BLOCK):
        before = min(at, WINDOW)
        part = gear(data[at - before : at + BLOCK])[before:]
        candidates.append(np.flatnonzero(part < np.uint64(2**64 // MEAN_CHUNK)) + at + 1)
    inner = np.ones(n + 1, bool)
    inner[:n] = (data & 0xC0) != 0x80
    ends, last = [], 0
    for c in np.concatenate(candidates).tolist() if candidates else []:
        while c - last > MAX_CHUNK:
            last += MAX_CHUNK
            while not inner[last]:
                last -= 1
            ends.append(last)
        if inner[c]:
            ends.append(c)
            last = c
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        while not inner[last]:
            last -= 1
        ends.append(last)
    if last < n:
        ends.append(n)
    return np.array(ends, np.int64)


def chunks(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, sizes, words that begin in it, digests) of the chunks of a text."""
    data = np.frombuffer(text, np.uint8)
    ends = chunk_ends(data)
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    if not len(ends):
        return starts, ends, ends, np.empty(0, np.uint64)
    gap = _IS_GAP[data]
    begins = ~gap
    begins[1:] &= gap[:-1]
    words = np.add.reduceat(begins.astype(np.int32), starts)
    sizes = ends - starts
    place = (np.arange(len(data)) - np.repeat(starts, sizes)).astype(np.int64)
    digest = np.add.reduceat(_GEAR[data] * _powers()[place], starts)
    return starts, sizes, words, mix(digest + sizes.astype(np.uint64))


def _powers(cache: list = []) -> np.ndarray:  # noqa: B006  kept between calls
    if not cache:
        up = np.full(MAX_CHUNK + 1, _BASE)
        up[0] = 1
        cache.append(np.cumprod(up, dtype=np.uint64))
    return cache[0]


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=500_000):
        rows = list(zip(batch.column("doc_id").to_pylist(), batch.column("row_hash").to_pylist(), strict=True))
        first = {row: i for i, row in reversed(list(enumerate(rows)))}  # equal rows are one document
        found = [chunks(t) if first[rows[i]] == i else chunks(b"") for i, t in enumerate(text_bytes(batch.column("text")))]
        took = pa.array(np.repeat(np.arange(batch.num_rows), [len(f[0]) for f in found]))
        if len(took):
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([f[3] for f in found]).view(np.int64)), batch.column("doc_id").take(took), batch.column("row_hash").take(took),
                pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]).astype(np.int32)), pa.array(np.concatenate([f[2] for f in found]).astype(np.int32)),
            ], ["digest", "doc_id", "row_hash", "start", "size", "words"])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, row_hash, start, end, n_words, owner_ids of every repeated passage, in the documents that do not own it."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = own.withColumn("row_hash", F.xxhash64("doc_id", "text"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = own.mapInArrow(_chunk_rows, f"digest long, doc_id {kind}, row_hash long, start long, size int, words int")
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count("*").alias("uses"), F.count("doc_id").alias("named"))
    shared = materialise(groups.where("owner <> last or named < uses").select("digest", "owner", "uses"), "shared-chunks")
    total = shared.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0]
    told = lookup(rows, shared, ["digest"], "uses", max(total, 1)).where(F.col("uses").isNotNull())
    told = materialise(told.select("digest", "doc_id", "row_hash", "start", "size", "words", "owner", "uses"), "repeated-chunks")
    # dealt by document once: equal rows are dropped and runs are found in the same partitions
    dealt = told.where(~F.col("doc_id").eqNullSafe(F.col("owner"))).repartition("doc_id", "row_hash").dropDuplicates(["doc_id", "row_hash", "start"])
    text = Window.partitionBy("doc_id", "row_hash").orderBy("start")
    opens = F.when(F.col("start") == F.lag(F.col("start") + F.col("size")).over(text), 0).otherwise(1)
    runs = dealt.withColumn("opens", opens).withColumn("run", F.sum("opens").over(text))
    ends = [F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"), F.sum("words").alias("n_words"), F.min_by("digest", "uses").alias("rarest"), F.min_by("start", "uses").alias("rarest_at"), F.max_by("digest", "size").alias("longest"), F.max_by("start", "size").alias("longest_at"), F.array_sort(F.collect_set("owner")).alias("owner_ids")]
    spans = runs.groupBy("doc_id", "row_hash", "run").agg(*ends).where(F.col("n_words") >= min(LOW_WORDS, min_words)).drop("run")
    spans = materialise(spans, "runs")
    columns = ["doc_id", "row_hash", "start", "end", "n_words", "owner_ids"]
    closer = _grown(own, told, spans.where(F.col("n_words") < min_words)).where(F.col("n_words") >= min_words)
    return spans.where(F.col("n_words") >= min_words).select(*columns).unionByName(closer.select(*columns))


def _grown(own: DataFrame, told: DataFrame, spans: DataFrame) -> DataFrame:
    """spans with start, end and n_words of what agrees with the text around the same chunk in the chunk's owner; the longer of two anchors."""
    either = F.explode(F.array(*(F.struct(F.col(k).alias("key"), F.col(f"{k}_at").alias("at")) for k in ("rarest", "longest")))).alias("x")
    anchors = materialise(spans.select("doc_id", "row_hash", "start", "end", "owner_ids", either).select("*", "x.*").drop("x").distinct(), "anchors")
    uses = anchors.groupBy("key").agg(F.count("*").alias("uses"))
    homes = told.where("doc_id = owner").join(uses, F.col("digest") == F.col("key"), "left_semi").groupBy("digest").agg(F.min("row_hash").alias("o_row"), F.min_by("start", "row_hash").alias("o_at"))
    homes = materialise(homes.join(uses, F.col("digest") == F.col("key")).select("key", "uses", "o_row", "o_at"), "homes")
    asked = lookup(anchors, homes, ["key"], "uses", max(1, anchors.count())).where("o_row is not null").drop("uses", "key")
    before = F.least(F.col("at") - F.col("start") + REACH, "at", "o_at")
    asked = materialise(asked.withColumns({"before": before, "size": before + F.col("end") - F.col("at") + REACH, "d_from": F.col("at") - before, "o_from": F.col("o_at") - before}), "asked")
    wanted = asked.select(F.col("row_hash").alias("p_row"), F.col("d_from").alias("from"), "size").unionByName(asked.select(F.col("o_row").alias("p_row"), F.col("o_from").alias("from"), "size")).distinct()
    lists = small(materialise(wanted.groupBy("p_row").agg(F.collect_list(F.struct("from", "size")).alias("places")), "places"))
    each = own.join(lists, F.col("row_hash") == F.col("p_row")).select("p_row", "text", F.explode("places").alias("place"))
    piece = F.substring(F.col("text").cast("binary"), F.col("place.from").cast("int") + 1, F.col("place.size").cast("int"))
    pieces = materialise(each.select("p_row", F.col("place.from").alias("p_from"), F.col("place.size").alias("p_size"), piece.alias("piece")).groupBy("p_row", "p_from", "p_size").agg(F.first("piece").alias("piece")), "pieces")
    mine = pieces.select(F.col("p_row").alias("m_row"), F.col("p_from").alias("m_from"), F.col("p_size").alias("m_size"), F.col("piece").alias("mine"))
    mine = materialise(asked.join(mine, (F.col("row_hash") == F.col("m_row")) & (F.col("d_from") == F.col("m_from")) & (F.col("size") == F.col("m_size"))).drop("m_row", "m_from", "m_size"), "own-pieces")
    uses = mine.groupBy("o_row", "o_from", "size").agg(F.count("*").alias("uses"))
    theirs = pieces.select(F.col("p_row").alias("o_row"), F.col("p_from").alias("o_from"), F.col("p_size").alias("size"), F.col("piece").alias("theirs")).join(uses, ["o_row", "o_from", "size"])
    both = lookup(mine, materialise(theirs, "their-pieces"), ["o_row", "o_from", "size"], "uses", max(1, mine.count()))
    kind = own.schema["doc_id"].dataType.simpleString()
    found = both.where("theirs is not null").select("doc_id", "row_hash", "start", "d_from", "before", "owner_ids", "mine", "theirs").mapInArrow(_agreeing, f"doc_id {kind}, row_hash long, run long, start long, end long, n_words long, owner_ids array<{kind}>")
    best = F.row_number().over(Window.partitionBy("doc_id", "row_hash", "run").orderBy(F.desc("n_words"), "start"))
    return found.withColumn("best", best).where("best = 1").drop("best", "run")


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole words around each anchor at which two pieces agree: start and end in the document, and their number."""
    for batch in batches:
        start, end, words = [], [], []
        for at, before, mine, theirs in zip(*(batch.column(c).to_pylist() for c in ("d_from", "before", "mine", "theirs")), strict=True):
            x, y = np.frombuffer(mine, np.uint8), np.frombuffer(theirs, np.uint8)
            n = min(len(x), len(y))
            apart = np.flatnonzero(x[:n] != y[:n])
            low = int(apart[apart < before][-1]) + 1 if (apart < before).any() else 0
            high = int(apart[apart >= before][0]) if (apart >= before).any() else n
            gap = np.concatenate(([at == 0], _IS_GAP[x], [True]))  # gap[i] is the byte before i; a piece ends with the text or REACH bytes on
            begins = np.flatnonzero(gap[:-2] & ~gap[1:-1])
            ends = np.flatnonzero(~gap[1:-1] & gap[2:]) + 1
            begins = begins[(begins >= low) & (begins < high)]
            ends = ends[(ends > low) & (ends <= high)]
            if len(begins) and len(ends) and ends[0] <= begins[0]:
                ends = ends[1:]  # the end of a word that begins before
            begins = begins[: len(ends)]
            words.append(len(begins))
            start.append(at + int(begins[0]) if len(begins) else at)
            end.append(at + int(ends[len(begins) - 1]) if len(begins) else at)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row_hash"), batch.column("start"), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(words, pa.int64()), batch.column("owner_ids")],
            ["doc_id", "row_hash", "run", "start", "end", "n_words", "owner_ids"],
        )


def without_repeats(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated passages cut out of their texts."""
    cuts = spans.groupBy("doc_id", "row_hash").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__cuts"))
    cuts = small(materialise(cuts.select(F.col("doc_id").alias("__id"), F.col("row_hash").alias("__rh"), "__cuts"), "cuts"))
    met = docs.withColumn("__row", F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))).join(cuts, (F.col("__row") == F.col("__rh")) & F.col(id_col).eqNullSafe(F.col("__id")), "left")
    raw = F.col(text_col).cast("binary")
    froms = F.concat(F.array(F.lit(0).cast("long")), F.transform("__cuts", lambda c: c["end"]))
    tos = F.concat(F.transform("__cuts", lambda c: c["start"]), F.array(F.octet_length(F.col(text_col)).cast("long")))
    kept = F.transform(F.arrays_zip(froms.alias("a"), tos.alias("b")), lambda p: F.substring(raw, p["a"].cast("int") + 1, (p["b"] - p["a"]).cast("int")).cast("string"))
    return met.withColumn(text_col, F.when(F.col("__cuts").isNull(), F.col(text_col)).otherwise(F.array_join(kept, ""))).select(*docs.columns)


def op10_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated passage of the documents: doc_id, start, end, n_words, owner_ids."""
    return repeats(table(spark, sf_dir, "documents")).select("doc_id", "start", "end", "n_words", "owner_ids")
