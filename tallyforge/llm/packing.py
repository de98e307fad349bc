"""Best-fit packing of token pieces by a configuration linear program.

A document becomes its token ids and an end id; longer ones are cut into pieces of
`capacity`, the first of which may be shorter. How the pieces fill sequences is decided
on their length histogram alone, which has at most `capacity` entries however large the
corpus is: minimise the number of sequences over configurations (multisets of lengths
that fit), each length covered as often as it occurs. The covering program is solved by
multiplicative weights: the price of a length falls as it gets covered, and a knapsack
dynamic program finds the dearest configurations. The fractional counts are rounded down,
and what is left is solved once more; only what rounding leaves then is placed best-fit.

The plan is a small table of runs, (length, first rank, copies a sequence, first sequence,
offset). Pieces are ranked within their length in hash buckets, without gathering a
length in one task, and find their run by a broadcast join. A piece of full length is a
sequence of its own: it takes a negative number from its place in the stored table, without
any shuffle.

Edge cases: a null text is empty and gives one piece, the end id. Repeated rows and ids
are packed each on their own. Texts that hold the tokenizer's special strings are encoded
as the tokenizer does by default. An empty table gives no pieces. Only id and text are read.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import slices, table
from tallyforge.plans.scratch import materialise
from tallyforge.plans.skew import explode_copies, rank_within

CAPACITY = 1024
END_ID = 2
#: Multiplicative weights: most rounds, the share of a length's need that a round covers, and how far below the best price a configuration may be.
ROUNDS, STEP, SLACK = 400, 0.1, 0.2
#: Shares of a sequence that a rounded configuration may leave empty; how often the program is solved.
EMPTY, NEAR, LEVELS = (0, 1 / 512, 1 / 64, 1), 1.0005, 2
#: A bucket in which pieces of one length are ranked holds about this many rows at most, and no more than a 2,048th of all.
RANKED_ROWS, RANKED_PARTS = 1_000_000, 2048
#: White space in a row from which a text is left to tokenizers: tiktoken's matcher stacks a state a character and panics near a million.
LONG_GAP = 100_000
_LONG_GAP = re.compile(rf"(?<!\s)\s{{{LONG_GAP}}}")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def encoder(path: str):
    """A function from text to ids, equal to Tokenizer.encode(text, add_special_tokens=False).ids.

    Byte-level BPE with the usual word pattern and no normaliser is run by tiktoken on the
    same vocabulary, which is several times faster; anything else, and any text with one of
    the tokenizer's added tokens or a run of LONG_GAP white space in it, is left to tokenizers.
    """
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    spec = json.load(open(path, encoding="utf-8"))
    added = [t["content"] for t in spec.get("added_tokens", [])]
    slow = lambda text: own.encode(text, add_special_tokens=False).ids
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer") and not model.get("continuing_subword_prefix")
    if not plain:
        return slow
    import tiktoken

    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in word): i for word, i in model["vocab"].items() if word not in added}
    merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    in_order = [i for w, i in sorted(model["vocab"].items(), key=lambda x: x[1]) if w not in added] == list(range(len(ranks)))
    if not in_order or merged != sorted(set(merged)) or len(merged) + 256 != len(ranks):  # tiktoken merges in the order of the vocabulary
        return slow
    # Fixed value: the word pattern of byte-level BPE.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: slow(text) if any(a in text for a in added) or (len(text) >= LONG_GAP and _LONG_GAP.search(text)) else fast(text)


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level BPE writes for each byte, as a map back to the byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than capacity."""
    if length <= capacity:
        return [(0, length)]
    head = length % capacity
    starts = ([0] if head else []) + list(range(head, length, capacity))
    return [(s, head if head and s == 0 else capacity) for s in starts]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, row_hash, piece, start, length, ids_crc32 and (with_ids) ids of every piece."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_hash"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {kind}, row_hash long, piece int, start long, length int, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in slices(batches, limit=1_000_000):
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                x = np.array([*(encode(t) if t else ()), end_id], np.uint32)
                for k, (s, n) in enumerate(cut(len(x), capacity)):
                    at.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    own = x[s : s + n]
                    crc.append(zlib.crc32(own.astype("<u4").tobytes()))
                    if with_ids:
                        ids.append(own.astype(np.int32))
            took = pa.array(at, pa.int64())
            columns = [batch.column("doc_id").take(took), batch.column("row_hash").take(took), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), ["doc_id", "row_hash", "piece", "start", "length", "ids_crc32", "ids"][: 6 + with_ids])

    return text.mapInArrow(run, schema)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing on a histogram: [(configuration ((length, copies), ...), sequences)].

    Equal sequences are handled together: pieces of one length go first to the open
    sequences with the least room that is enough.
    """
    open_by_room: dict[int, dict[tuple, int]] = {}
    rooms: list[int] = []

    def put(config: tuple, room: int, n: int) -> None:
        if room not in open_by_room:
            open_by_room[room] = {}
            bisect.insort(rooms, room)
        open_by_room[room][config] = open_by_room[room].get(config, 0) + n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                each = min(left, capacity // length)
                n = left // each
                put(((length, each),), capacity - each * length, n)
                left -= n * each
                continue
            room = rooms[i]
            config, n = open_by_room[room].popitem()
            if not open_by_room[room]:
                del open_by_room[room]
                rooms.pop(i)
            each = room // length
            if left < each:
                used, each = 1, left
            else:
                used = min(n, left // each)
            if n > used:
                put(config, room, n - used)
            put((*config, (length, each)), room - each * length, used)
            left -= used * each
    return [(config, n) for configs in open_by_room.values() for config, n in configs.items()]


def knapsack(lengths: np.ndarray, weights: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(most weight of a multiset that fits, first length to take or -1 to leave a place empty) for every room up to capacity."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(int(lengths[0]), capacity + 1):
        n = fitting[room]
        value = best[room - lengths[:n]] + weights[:n]
        i = int(value.argmax())
        if value[i] > best[room - 1]:
            best[room], choice[room] = value[i], i
        else:
            best[room] = best[room - 1]
    return best, choice


def filled(choice: np.ndarray, lengths: np.ndarray, room: int) -> dict[int, int]:
    """Copies of each length (by number) in the multiset that the dynamic program chose for a room."""
    copies: dict[int, int] = {}
    while room > 0:
        i = int(choice[room])
        if i < 0:
            room -= 1
        else:
            copies[i] = copies.get(i, 0) + 1
            room -= int(lengths[i])
    return copies


def fractional(lengths: np.ndarray, need: np.ndarray, capacity: int, rounds: int = ROUNDS, step: float = STEP, slack: float = SLACK) -> dict[tuple, float]:
    """{configuration ((length number, copies), ...): sequences} of the covering program, by multiplicative weights.

    A length's price is its volume times exp(-coverage / step). One dynamic program prices
    all configurations of a round: for every length, the dearest one that contains it. Those
    within `slack` of the dearest are taken, the least covered lengths first and each length
    in one configuration a round, `step` of the need at a time.
    """
    covered, used = np.zeros(len(lengths)), {}
    for _ in range(rounds):
        progress = covered / need
        if progress.min() >= 1 - 1e-9:
            break
        prices = lengths * np.exp(-(progress - progress.min()) / step)
        best, choice = knapsack(lengths, prices, capacity)
        value = prices + best[capacity - lengths]
        taken = np.zeros(len(lengths), bool)
        for i in np.argsort(progress, kind="stable"):
            if taken[i] or value[i] < (1 - slack) * best[capacity]:
                continue
            copies = filled(choice, lengths, capacity - int(lengths[i]))
            copies[int(i)] = copies.get(int(i), 0) + 1
            if any(taken[j] for j in copies):
                continue
            amount = min(need[j] * step / k for j, k in copies.items())
            for j, k in copies.items():
                covered[j] += amount * k
                taken[j] = True
            key = tuple(sorted(copies.items()))
            used[key] = used.get(key, 0.0) + amount
    return used


def rounded(used: dict[tuple, float], sizes: np.ndarray, left: np.ndarray, capacity: int, most_empty: int) -> list[tuple[tuple, int]]:
    """The fractional configurations rounded down, those of most sequences first and none that leaves more than `most_empty` empty."""
    left, out = left.copy(), []
    for key, amount in sorted(used.items(), key=lambda x: -x[1]):
        if capacity - sum(int(sizes[j]) * k for j, k in key) <= most_empty:
            n = min(int(amount), *(int(left[j]) // k for j, k in key))
            if n:
                for j, k in key:
                    left[j] -= n * k
                out.append((tuple((int(sizes[j]), k) for j, k in reversed(key)), n))
    return out


def without(counts: dict[int, int], plan: list[tuple[tuple, int]]) -> dict[int, int]:
    """A histogram less the pieces of a plan."""
    left = dict(counts)
    for config, n in plan:
        for length, k in config:
            left[length] -= n * k
    return {length: n for length, n in left.items() if n}


def solve(counts: dict[int, int], capacity: int, levels: int = LEVELS) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Configurations and how many sequences take each, covering a length histogram exactly.

    Configurations that leave room empty can be used or left out in rounding. Of a few such
    limits (EMPTY) those are near the best whose plan, with the rest best-fit, has at most NEAR
    times the fewest sequences; of these the one that leaves least to best-fit is taken.
    What rounding left is solved once more (`levels` times in all), and what no whole
    sequence was found for then is placed best-fit decreasing.
    """
    left, plan = {k: v for k, v in counts.items() if v > 0}, []
    for _ in range(levels):
        if not left:
            break
        sizes = np.array(sorted(left), np.int64)
        need = np.array([left[int(k)] for k in sizes], np.int64)
        used = fractional(sizes, need.astype(float), capacity)
        tried = [p for share in EMPTY if (p := rounded(used, sizes, need, capacity, int(capacity * share)))]
        if not tried:
            break
        totals = [sum(n for _, n in p + best_fit(without(left, p), capacity)) for p in tried]
        best = max((p for p, n in zip(tried, totals, strict=True) if n <= NEAR * min(totals)), key=lambda p: sum(n for _, n in p))
        plan, left = plan + best, without(left, best)
    return plan + best_fit(left, capacity)


def runs_of(plan: list[tuple[tuple[tuple[int, int], ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, copies a sequence, first sequence, offset) of a plan."""
    rank, sequence, out = {}, 0, []
    for config, n in plan:
        offset = 0
        for length, copies in config:
            first = rank.get(length, 0)
            out.append((length, first, first + n * copies, copies, sequence, offset))
            rank[length] = first + n * copies
            offset += length * copies
        sequence += n
    return out


def pack(slim: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """slim (doc_id, row_hash, piece, start, length, ids_crc32; stored) with sequence_id and offset."""
    spark = slim.sparkSession
    counts = {r["length"]: r["n"] for r in slim.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    counts.pop(capacity, 0)
    total = sum(counts.values())
    runs = spark.createDataFrame(runs_of(solve(counts, capacity)) or [(-1, 0, 0, 1, 0, 0)], "r_length int, first long, last long, each long, sequence long, at long")
    columns = ["doc_id", "row_hash", "piece", "start", "length", "ids_crc32"]
    whole = slim.where(F.col("length") == capacity).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    buckets = spark.createDataFrame([(k, max(-(-n // RANKED_ROWS), -(-n * RANKED_PARTS // total))) for k, n in counts.items()] or [(-1, 1)], "b_length int, buckets long")
    grouped = slim.where(F.col("length") < capacity).groupBy(*columns).agg(F.count("*").alias("copies"))
    grouped = grouped.join(F.broadcast(buckets), F.col("length") == F.col("b_length")).drop("b_length")
    ranked = rank_within(grouped, "length", ["doc_id", "row_hash", "piece", "start", "ids_crc32"], "rank", copies="copies", spread=F.col("buckets")).drop("buckets")
    each = explode_copies(ranked, "copies", "copy").withColumn("rank", F.col("rank") + F.col("copy")).drop("copy")
    placed = each.join(F.broadcast(runs), (F.col("length") == F.col("r_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    nth = F.col("rank") - F.col("first")
    shorter = placed.select(*columns, (F.col("sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"), (F.col("at") + (nth % F.col("each")) * F.col("length")).cast("long").alias("offset"))
    return shorter.unionByName(whole)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(sequence_id, ids): the packed token sequences themselves; a sequence has at most `capacity` ids."""
    key = ["doc_id", "row_hash", "piece"]
    nth = Window.partitionBy(*key).orderBy(F.lit(0))
    own = pieces(docs, tokenizer, capacity, end_id).withColumn("nth", F.row_number().over(nth)).select(*(F.col(k).alias(f"p_{k}") for k in [*key, "nth"]), "ids")
    spot = placed.withColumn("nth", F.row_number().over(nth))
    met = spot.join(own, [F.col(k).eqNullSafe(F.col(f"p_{k}")) for k in [*key, "nth"]])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return met.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


def packed(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of docs with its place."""
    slim = pieces(docs, tokenizer or default_tokenizer(), capacity, end_id, id_col, text_col, with_ids=False)
    return pack(materialise(slim, "pieces"), capacity)


def placements(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return packed(docs, tokenizer).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op6_config_lp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens, one row per piece."""
    return placements(table(spark, sf_dir, "documents"))
