"""The corpus pipeline as a whole: against plain steps, and on odd and empty tables."""

import random
import re

import corpus_pipeline
import pytest
from prose_words import prose

from tallyforge.llm import decontam
from tallyforge.llm.words import LOWER
from tallyforge.plans.scratch import materialise


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER).decode())


def stages_on(spark, d):
    """What each stage returns, written and read again as the next one's input."""
    docs, out = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, d), name.replace(" ", "-"))
        out.append(docs)
    return out


@pytest.fixture(scope="module")
def planted(make_dir):
    rng, docs = random.Random(11), []
    add = lambda text: docs.append((len(docs) + 1, text, "en", "s", 0))
    for k in range(30):
        add(prose(k, 60 + 7 * k))
    for k in (3, 3, 5):
        add(prose(k, 60 + 7 * k).upper())
    for k in (8, 9, 9):
        near = prose(k, 60 + 7 * k).split()
        near[rng.randrange(len(near))] = "otherword"
        add(" ".join(near))
    items = [(1, prose(400, 30)), (2, prose(401, 24))]
    add(f"{prose(500, 40)} {items[0][1]} {prose(501, 30)}")
    edited = items[1][1].split()
    edited[5] = edited[15] = "changed"
    add(f"{prose(502, 40)} {' '.join(edited)} {prose(503, 30)}")
    add("12 !! ??")
    add(None)
    return make_dir(docs, {c: "'clash'" for c in ("digest", "node", "row_hash", "copies", "mark", "id")}, items=items), docs, items


def test_stages_equal_plain_steps(spark, planted):
    d, docs, items = planted
    text = {i: t for i, t, *_ in docs}
    got = [{r.doc_id for r in s.select("doc_id").distinct().collect()} for s in stages_on(spark, d)]
    want = {i for i, t in text.items() if t and re.search(r"[^\W\d_]", t)}
    assert got[0] == want
    last = {}
    for i in sorted(want):
        last["".join(c.lower() if "A" <= c <= "Z" else c for c in text[i])] = i
    want = set(last.values())
    assert got[1] == want
    sets = {i: {tuple(words_of(text[i])[k : k + 5]) for k in range(len(words_of(text[i])) - 4)} for i in want}
    label = {i: i for i in want}
    for _ in want:  # as many rounds as it can take
        for i in want:
            for j in want:
                if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    want = {i for i in want if label[i] == i}
    assert got[2] == want

    def leaks(t):
        window = decontam.word_hashes(decontam.normalised([t.encode()]))[0]
        for _, item in items:
            query = decontam.word_hashes(decontam.normalised([item.encode()]))[0]
            if (decontam.align(query, window)[0] + len(query)) / (2 * len(query)) >= 0.75:
                return True
        return False

    want = {i for i in want if not leaks(text[i])}
    assert got[3] == got[4] == want and len(want) < 32


def test_run_packs_what_the_stages_leave(spark, planted):
    from tokenizers import Tokenizer

    from tallyforge.llm import packing

    d, docs, _ = planted
    own, text = Tokenizer.from_file(packing.default_tokenizer()), {i: t for i, t, *_ in docs}
    rows = corpus_pipeline.run(spark, d).collect()
    ids = {}
    for r in rows:
        ids.setdefault(r.doc_id, []).append(r.length)
    assert all(sum(n) == len(own.encode(text[i], add_special_tokens=False).ids) + 1 for i, n in ids.items())
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        assert [o for o, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:k]) for k in range(len(p))] and sum(n for _, n in p) <= 1024


def test_odd_tables(spark, odd_dir):
    source = spark.read.parquet(f"{odd_dir}/documents.parquet")
    out = stages_on(spark, odd_dir)
    assert all(s.columns == source.columns for s in out[:-1])
    kept = [{(r.doc_id, r.text) for r in s.select("doc_id", "text").collect()} for s in out[:-1]]
    assert all(b <= a for a, b in zip(kept, kept[1:], strict=False)) and not any(t is None or not re.search(r"[^\W\d_]", t) for _, t in kept[0])
    assert out[1].count() == len(kept[1]) and {r.doc_id for r in out[4].select("doc_id").collect()} == {i for i, _ in kept[3]}


def test_empty_tables(spark, empty_dir):
    assert [s.count() for s in stages_on(spark, empty_dir)] == [0] * 5
