"""Phrase collocations against plain counting, and what the summaries promise."""

import re
from collections import Counter

import numpy as np
import pytest

from tallyforge.llm import phrases
from tallyforge.llm.words import mix

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, top):
    f, n = {}, Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, own in f.items():
        rated = []
        for p, a in own.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in own.items() if b >= least):
                continue
            score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            rated.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(rated)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("top", [5, 1000])
def test_phrases_equal_plain_counting(spark, top):
    rng = np.random.default_rng(3)
    words = ["an", "Öl", "naïve", "b c", "x\u0000y", "THE", "the", "of", "<|a|>", "-"]
    docs = []
    for i in range(300):
        parts = [words[k] for k in rng.integers(0, len(words), rng.integers(0, 40))]
        text = "".join(w + str(rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\x0b", ";"])) for w in parts)
        docs.append((text + (" new york city hall now" * int(rng.integers(0, 3))), [None, "und", "en", "de"][i % 4]))
    docs += [(None, "en"), ("", None), ("only. one, two", None), (" the the the the the the the", "fr")] * 3
    df = spark.createDataFrame(docs, "text string, lang string").selectExpr("text", "lang", "1 AS slot", "'c' AS phrase", "2 AS n")
    got = sorted(map(tuple, phrases.collocations(df.repartition(5), least=6, top=top).collect()))
    assert got == brute(docs, 6, top) and len(got) > 10


def test_summaries_keep_every_frequent_key(monkeypatch):
    monkeypatch.setattr(phrases, "SLOT_BITS", 3)
    rng = np.random.default_rng(5)
    stream = mix(np.minimum(rng.zipf(1.2, 60_000), 20_000).astype(np.uint64))
    least = 100
    mass = np.bincount(phrases.slot_of(stream), minlength=8)
    own = phrases.Summaries(mass // least + 1)
    for part in np.array_split(stream, 40):
        own.merge(*phrases.added(part, np.ones(len(part), np.int64)))
        assert (np.bincount(phrases.slot_of(own.keys), minlength=8) <= own.capacity).all()
    keys, counts = phrases.added(stream, np.ones(len(stream), np.int64))
    true = dict(zip(keys.tolist(), counts.tolist(), strict=True))
    assert (own.lost < least).all() and own.lost.max() > 0
    assert all(c <= true[k] <= c + own.lost[s] for k, c, s in zip(own.keys.tolist(), own.counts.tolist(), phrases.slot_of(own.keys).tolist(), strict=True))
    frequent = {k for k, c in true.items() if c >= least}
    assert frequent <= set(own.survivors(least).tolist()) and len(own.survivors(least)) < len(true) / 5
    # two summaries merge into one that keeps the same promise
    halves = []
    for part in np.array_split(stream, 2):
        half = phrases.Summaries(mass // least + 1)
        half.merge(*phrases.added(part, np.ones(len(part), np.int64)))
        halves.append(half)
    halves[0].lost += halves[1].lost
    halves[0].merge(halves[1].keys, halves[1].counts)
    assert frequent <= set(halves[0].survivors(least).tolist()) and (halves[0].lost < least).all()


def test_the_filter_holds_all_survivors(spark):
    keys = mix(np.arange(50_000, dtype=np.uint64))
    df = spark.createDataFrame([(k,) for k in keys[:5000].view(np.int64).tolist()], "key long")
    table = phrases._filter(spark, df)
    assert phrases.told(table, keys[:5000]).all() and phrases.told(table, keys[5000:]).mean() < 0.001


def test_small_memory_changes_nothing(spark, monkeypatch):
    docs = [(f"alpha beta gamma {i % 7} delta alpha beta. gamma {i % 3}", "en") for i in range(200)]
    df = spark.createDataFrame(docs, "text string, lang string").repartition(3)
    whole = sorted(map(tuple, phrases.collocations(df, least=20).collect()))
    for name, value in (("HELD", 50), ("SPELLED", 3), ("SENT", 7)):
        monkeypatch.setattr(phrases, name, value)
    assert sorted(map(tuple, phrases.collocations(df, least=20).collect())) == whole == brute(docs, 20, 2000)
