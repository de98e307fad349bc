"""Alignment of two tokenizers over a corpus, and which of their ids go together.

A text's tokens by A and by B cover the same bytes; where tokens of both end, the text is cut
into groups, and tokens whose bytes overlap are linked. Two overlapping tokens share one
stretch between neighbouring token ends, so the links are these stretches.

Both tokenizers work word by word, so a task aligns each different word (a run of white space
and what follows it) once and sums up the texts from that. A-id to B-id with the same bytes is
an array made beforehand; a group of one such pair is regular and is counted in a vector as
long as A's vocabulary. Only the links of other groups are counted by pair through a shuffle,
where a task's equal pairs are one row; the vectors join them as sums, at most one row for
each id of A and task.

A second walk gives each text its sums. Pairs with more than 1 / HOT_PAIRS of all links, of which
fewer than HOT_PAIRS can exist, and the pairs of the identity array go along in sorted arrays. The
links of all rarer pairs, none of which can be a hot key, are joined with the counts afterwards.

Edge cases: a text that is null or empty, or that a tokenizer does not give back byte by byte (as
U+2581 in B), has no tokens: zeros and an empty hash. Special strings are plain text. Repeated rows
and ids count each. Long runs without a space are one word. Empty tables give no rows. Only id and
text are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import slices, table
from tallyforge.llm.packing import _byte_letters as byte_letters
from tallyforge.llm.packing import encoder
from tallyforge.plans.scratch import materialise

HOT_PAIRS = 1 << 20
#: Words, and characters of words, that a task remembers before it starts afresh; pairs whose counts it holds; rows of an Arrow batch.
KNOWN, KNOWN_CHARS, HELD, SENT = 400_000, 8_000_000, 2_000_000, 250_000
#: Words that are encoded as one text, and characters from which a word is encoded by itself.
TOGETHER, LONG = 200, 1000
#: Before a space that follows what neither tokenizer takes for white space.
_CUT = re.compile(r"(?<=\S)(?= )")
_SPACE = "▁"


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _plain(path: str, added: list[str]) -> Callable:
    """A function from text to ids that takes the strings of special tokens for plain text."""
    from tokenizers import Tokenizer

    own, usual = Tokenizer.from_file(path), encoder(path)
    own.encode_special_tokens = True
    return lambda text: own.encode(text, add_special_tokens=False).ids if any(a in text for a in added) else usual(text)


class Pair:
    """Both tokenizers, the bytes of their tokens, and the identity array."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece

        spec = json.load(open(a_path, encoding="utf-8"))
        self.encode_a = _plain(a_path, [t["content"] for t in spec.get("added_tokens", [])])
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        added = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
        self.bytes_a = [b""] * (1 + max([*vocab.values(), *added]))
        for word, i in vocab.items():
            self.bytes_a[i] = bytes(letters[c] for c in word) if i not in added and all(c in letters for c in word) else added.get(i, word.encode())
        for i, content in added.items():
            self.bytes_a[i] = content
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        written = {x: i for i, x in reversed(list(enumerate(self.bytes_b))) if not self.b.is_byte(i)}
        single = {x: i for i, x in enumerate(self.bytes_b) if self.b.is_byte(i)}
        self.same = np.array([written.get(x, single.get(x, -1)) for x in self.bytes_a], np.int64)
        #: Whether both take a text word by word.
        self.cuts = (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec.get("normalizer") and not any(_SPACE in p.lstrip(_SPACE) for p in pieces)
        #: An id as it is written before another id of its side, before the other side, and before the next group.
        self.written_a = [f"{i}{end}".encode() for end in ",|" for i in range(len(self.bytes_a))]
        self.written_b = [f"{i}{end}".encode() for end in (",", ";", "") for i in range(len(self.bytes_b))]

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Both sides' ids of words, each of which begins with a space, or None if one side's bytes are not the words'."""
        texts = ["".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)]
        a = list(chain.from_iterable(map(self.encode_a, texts)))
        b = list(chain.from_iterable(self.b.encode([t[1:] for t in texts], num_threads=1)))
        own = "".join(texts).encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != own or b"".join(map(self.bytes_b.__getitem__, b)) != own:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


@lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


class Lexicon:
    """The words that a task has aligned: numbers a word, and the links of all words in a row."""

    COUNTS = ("a", "b", "groups", "links")

    def __init__(self, both: Pair, spelled: bool = True) -> None:
        """spelled: whether the groups are written out."""
        self.both, self.spelled = both, spelled
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.chars = 0
        self.n = {c: np.empty(0, np.int64) for c in self.COUNTS}
        self.good = np.empty(0, bool)
        self.keys, self.regular = np.empty(0, np.int64), np.empty(0, bool)
        self.text: list[bytes] = []

    @property
    def full(self) -> bool:
        return len(self.place) > KNOWN or self.chars > KNOWN_CHARS

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(words of all texts, where each text's begin); texts without tokens have none."""
        split = [self._split(" " + t) if t else [] for t in texts]
        begin = np.cumsum([0, *map(len, split)])
        flat = list(chain.from_iterable(split))
        self.learn(set(flat))
        at = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        bad = np.unique(np.searchsorted(begin, np.flatnonzero(~self.good[at]), "right") - 1)
        if not len(bad):
            return at, begin
        own = [at[i:j] for i, j in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
        for i in bad.tolist():  # the text as a whole tells
            whole = " " + texts[i]
            self.learn({whole})
            own[i] = np.array([self.place[whole]] if self.good[self.place[whole]] else [], np.int64)
        return np.concatenate(own), np.cumsum([0, *map(len, own)])

    def _split(self, text: str) -> list[str]:
        words = _CUT.split(text) if self.both.cuts else [text]
        if len(words) > 1 and words[-1] == " ":
            words[-2:] = [words[-2] + " "]
        return words

    def learn(self, words: set[str]) -> None:
        """Align the words that are new: those that end in no white space together, as their neighbours do not change them."""
        plain, alone = [], []
        for w in words - self.place.keys():
            (alone if w[-1].isspace() or len(w) > LONG or not self.both.cuts or _SPACE in w else plain).append(w)
        if plain:
            ids = self.both.ids(plain)
            if ids:
                self._add(plain, *ids)
            else:
                alone += plain
        for w in alone:
            self._add([w], *(self.both.ids([w]) or (None, None)))

    def _add(self, words: list[str], a: np.ndarray | None, b: np.ndarray | None) -> None:
        for w in words:
            self.place[w] = len(self.place)
        self.chars += sum(map(len, words))
        if a is None:
            self._append({c: np.zeros(1, np.int64) for c in self.COUNTS}, False, np.empty(0, np.int64), np.empty(0, bool), [b""])
            return
        both = self.both
        end_a, end_b = np.cumsum(both.len_a[a]), np.cumsum(both.len_b[b])
        group = end_a[end_b[np.minimum(np.searchsorted(end_b, end_a), len(end_b) - 1)] == end_a]
        of_a, of_b = np.searchsorted(group, end_a), np.searchsorted(group, end_b)
        size_a, size_b = np.bincount(of_a, minlength=len(group)), np.bincount(of_b, minlength=len(group))
        last_a, last_b = np.cumsum(size_a) - 1, np.cumsum(size_b) - 1
        regular = (size_a == 1) & (size_b == 1) & (both.same[a[last_a]] == b[last_b])
        stretch = np.sort(np.concatenate((end_a, end_b)), kind="stable")
        stretch = stretch[np.diff(stretch, prepend=-1) > 0]
        keys = a[np.searchsorted(end_a, stretch)] << 32 | b[np.searchsorted(end_b, stretch)]
        word_end = np.cumsum([len(w.encode()) for w in words])
        each = lambda ends: np.diff(np.searchsorted(ends, word_end, "right"), prepend=0)
        n = {"a": each(end_a), "b": each(end_b), "groups": each(group), "links": each(stretch)}
        if not self.spelled:
            self._append(n, True, keys, regular[np.searchsorted(group, stretch)], [b""] * len(words))
            return
        closes = word_end[np.minimum(np.searchsorted(word_end, group), len(words) - 1)] == group
        form_a = np.zeros(len(a), np.int64)
        form_a[last_a] = 1
        form_b = np.zeros(len(b), np.int64)
        form_b[last_b] = np.where(closes, 2, 1)
        order = np.argsort(np.concatenate((of_a * 2, of_b * 2 + 1)), kind="stable")
        shown = [*map(both.written_a.__getitem__, (a + form_a * len(both.bytes_a)).tolist()), *map(both.written_b.__getitem__, (b + form_b * len(both.bytes_b)).tolist())]
        shown = list(map(shown.__getitem__, order.tolist()))
        cuts = np.cumsum(n["a"] + n["b"]).tolist()
        self._append(n, True, keys, regular[np.searchsorted(group, stretch)], [b"".join(shown[i:j]) for i, j in zip([0, *cuts], cuts, strict=False)])

    def _append(self, n: dict[str, np.ndarray], good: bool, keys: np.ndarray, regular: np.ndarray, text: list[bytes]) -> None:
        for c in self.COUNTS:
            self.n[c] = np.concatenate((self.n[c], n[c]))
        self.good = np.concatenate((self.good, np.full(len(text), good)))
        self.keys, self.regular = np.concatenate((self.keys, keys)), np.concatenate((self.regular, regular))
        self.text += text


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of n, both empty if there are none."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _counted(a_path: str, b_path: str) -> Callable:
    """(a, b, n): a task's links in irregular groups by pair, and with b = -1 its vector of regular groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(a_path, b_path)
        known, used = Lexicon(both, spelled=False), np.empty(0, np.int64)
        vector = np.zeros(len(both.same), np.int64)
        keys, n = np.empty(0, np.int64), np.empty(0, np.int64)

        def settled(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            each = np.repeat(used, known.n["links"])
            odd = ~known.regular
            vector[:] += np.bincount(known.keys[known.regular] >> 32, each[known.regular], len(vector)).astype(np.int64)
            return _summed(np.concatenate((keys, known.keys[odd])), np.concatenate((n, each[odd])))

        def sent(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(keys), SENT):
                k = keys[i : i + SENT]
                yield pa.RecordBatch.from_arrays([pa.array((k >> 32).astype(np.int32)), pa.array((k & 0xFFFFFFFF).astype(np.int32)), pa.array(n[i : i + SENT])], ["a", "b", "n"])

        for batch in slices(batches):
            at, _ = known.words(batch.column("text").to_pylist())
            used = np.concatenate((used, np.zeros(len(known.place) - len(used), np.int64))) + np.bincount(at, minlength=len(known.place))
            if known.full:
                keys, n = settled(keys, n)
                known.clear()
                used = np.empty(0, np.int64)
            if len(keys) > HELD:
                yield from sent(keys, n)
                keys, n = keys[:0], n[:0]
        keys, n = settled(keys, n)
        yield from sent(keys[n > 0], n[n > 0])
        ids = np.flatnonzero(vector)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(np.full(len(ids), -1, np.int32)), pa.array(vector[ids])], ["a", "b", "n"])

    return run


def _told(a_path: str, b_path: str, hot: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Callable:
    """Each text's counts, hash, sums over the links whose pairs are in hot (sorted keys, counts, best), and its other links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, (hot_keys, hot_n, hot_best) = pair(a_path, b_path), hot
        known = Lexicon(both)
        for batch in slices(batches):
            at, begin = known.words(batch.column("text").to_pylist())
            found = np.minimum(np.searchsorted(hot_keys, known.keys), len(hot_keys) - 1)
            hit = hot_keys[found] == known.keys
            first = np.cumsum(known.n["links"]) - known.n["links"]
            total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[np.append(first, len(known.keys))])  # noqa: B023, E731
            by_word = known.n | {"best": total(np.where(hit, hot_best[found], 0)), "sum": total(np.where(hit, hot_n[found], 0))}
            by_text = {c: np.diff(np.concatenate(([0], np.cumsum(x[at])))[begin]) for c, x in by_word.items()}
            rare = np.flatnonzero(~hit)
            n_rare = total((~hit).astype(np.int64))
            first_rare = np.cumsum(n_rare) - n_rare
            many = n_rare[at]
            spots = np.repeat(first_rare[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            ends = np.concatenate(([0], np.cumsum(many)))[begin]
            shas = [hashlib.sha256(b";".join(map(known.text.__getitem__, at[i:j].tolist()))).hexdigest() if j > i else "" for i, j in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
            cold = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(known.keys[rare[spots]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), *(pa.array(by_text[c]) for c in ("a", "b", "groups", "links", "best", "sum")), pa.array(shas, pa.string()), cold],
                ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "cold"],
            )
            if known.full:
                known.clear()

    return run


def pair_counts(text: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(pair, n, best): how many links of all texts (column text) hold each pair, a << 32 | b, and whether that is its B-id's highest; stored."""
    spark = text.sparkSession
    both = pair(a_path, b_path)
    same = spark.createDataFrame([(int(a), int(both.same[a])) for a in np.flatnonzero(both.same >= 0)], "s_a int, s_b int")
    counted = materialise(text.select("text").mapInArrow(_counted(a_path, b_path), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    regular = counted.where("b < 0").join(F.broadcast(same), F.col("a") == F.col("s_a")).select("a", F.col("s_b").alias("b"), "n")  # one row an A-id
    totals = counted.where("b >= 0").unionByName(regular).groupBy("a", "b").agg(F.sum("n").alias("n"))
    totals = materialise(totals, "totals")
    most = totals.groupBy("b").agg(F.max("n").alias("most")).select(F.col("b").alias("m_b"), "most")
    key = F.call_function("shiftleft", F.col("a").cast("long"), F.lit(32)).bitwiseOR(F.col("b").cast("long"))
    rated = totals.join(F.broadcast(most), F.col("b") == F.col("m_b"))  # one row a B-id
    return materialise(rated.select(key.alias("pair"), "n", (F.col("n") == F.col("most")).cast("long").alias("best")), "counts")


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    own = default_tokenizers()
    a_path, b_path = a_path or own[0], b_path or own[1]
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = pair_counts(text, a_path, b_path)
    both = pair(a_path, b_path)
    links = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ids = docs.sparkSession.createDataFrame([(int(a) << 32 | int(both.same[a]),) for a in np.flatnonzero(both.same >= 0)], "pair long")
    often = counts.where(F.col("n") > links // hot_pairs)
    hot = often.unionByName(counts.where(F.col("n") <= links // hot_pairs).join(F.broadcast(ids), "pair", "left_semi")).toArrow()  # at most hot_pairs rows and one an A-id
    order = np.argsort(hot.column("pair").to_numpy())
    arrays = tuple(hot.column(c).to_numpy()[order] for c in ("pair", "n", "best")) if len(order) else (np.array([-1]),) * 3
    kind = docs.schema[id_col].dataType.simpleString()
    numbered = text.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    sums = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    told = materialise(numbered.mapInArrow(_told(a_path, b_path, arrays), f"row long, doc_id {kind}, {', '.join(f'{c} long' for c in sums)}, groups_sha256 string, cold array<long>"), "told")
    rest = told.select("row", F.explode("cold").alias("pair")).groupBy("row", "pair").agg(F.count("*").alias("times"))
    rare = counts.where(F.col("n") <= links // hot_pairs)
    added = rest.join(rare, "pair").groupBy(F.col("row").alias("of")).agg(F.sum(F.col("times") * F.col("best")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    out = told.join(added, F.col("row") == F.col("of"), "left")
    more = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0))).cast("long").alias(c)
    return out.select("doc_id", *sums[:4], more("n_best", "more_best"), more("count_sum", "more_sum"), "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment of every document by the byte-level and the piece tokenizer."""
    return align(table(spark, sf_dir, "documents"))
