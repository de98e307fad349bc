"""Token alignment against its definition, token by token."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from prose_words import prose

from tallyforge.llm import align

SAMPLES = [
    None, "", " ", "  ", "a ", "two  spaces", "tabs\tand\n\n lines \r\n x", " lead", "trail  ", "café naïve ﬁ ① Ωμέγα 日本語 \U0001F600\U0001F468‍\U0001F469", "the ▁ mark", "▁", "zero\u0000byte", "<|endoftext|> is plain <s> </s> <unk> <0x41>",
    "don't we'll I'm 'quoted'", "12345 3.14159 1,000,000", "x" * 3000, "nb space thin space 　wide", "\x1c\x1d odd \x85 blanks   end", "ABCabc" * 50 + " q", "    indented\n        more", "the the the the", prose(1, 400), prose(2, 150), prose(1, 400),
]


def brute(rows):
    """Per row: the columns, straight from the definition, with every text encoded whole."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = align.default_tokenizers()
    ta, tb = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    ta.encode_special_tokens = True
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    bytes_a = lambda i: bytes(letter[c] for c in ta.id_to_token(i))
    bytes_b = lambda i: bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode()
    found, counts = [], Counter()
    for text in rows:
        a, b = (ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)) if text else ([], [])
        pa, pb = [bytes_a(i) for i in a], [bytes_b(i) for i in b]
        if not text or b"".join(pa) != (" " + text).encode() or b"".join(pb) != (" " + text).encode():
            found.append(None)
            continue
        ea, eb = np.cumsum([len(x) for x in pa]).tolist(), np.cumsum([len(x) for x in pb]).tolist()
        groups, links, at = [], [], 0
        for end in sorted(set(ea) & set(eb)):
            groups.append(([i for i, e in zip(a, ea) if at < e <= end], [i for i, e in zip(b, eb) if at < e <= end]))
            at = end
        i = j = 0
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            step = ea[i] - eb[j]
            i, j = i + (step <= 0), j + (step >= 0)
        found.append((a, b, groups, links))
        counts.update(links)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(told.encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("hot", "known"), [(1 << 20, 200_000), (50, 20), (1, 200_000)])
def test_alignment_equals_its_definition(spark, monkeypatch, hot, known):
    monkeypatch.setattr(align, "KNOWN", known)
    monkeypatch.setattr(align, "HELD", known)
    rng = np.random.default_rng(4)
    alphabet = ["a", "B", " ", "  ", "\t", "\n", "é", "▁", "7", "-", "the", " of", "ing", "'s", "日", "\U0001F600", " ", "\x1d", ",", "x" * 30]
    rows = SAMPLES + ["".join(alphabet[k] for k in rng.integers(0, len(alphabet), rng.integers(1, 40))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").selectExpr("doc_id", "text", "1 AS row", "'c' AS pair", "2 AS n").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in align.align(df, hot_pairs=hot).collect()}
    want = brute(rows)
    assert [i for i in range(len(rows)) if got[i] != want[i]] == [] and sum(w[0] > 0 for w in want) > 100


def test_words_are_cut_where_both_tokenizers_cut():
    both = align.pair(*align.default_tokenizers())
    known = align.Lexicon(both)
    at, begin = known.words(["one two", None, "two  one ", ""])
    words = list(known.place)
    assert both.cuts and [words[i] for i in at] == [" one", " two", " two", "  one "] and begin.tolist() == [0, 2, 2, 4, 4]
    assert (both.same >= 0).sum() > 5000 and all(both.bytes_a[i] == both.bytes_b[j] for i, j in enumerate(both.same) if j >= 0)


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, None)], "doc_id long, text string")
    rows = sorted(map(tuple, align.align(df).collect()), key=str)
    assert len(rows) == 4 and len({r[1:] for r in rows if r[1]}) == 1 and rows[2][6] == 3 * rows[2][4]
