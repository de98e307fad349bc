"""Every corpus query over odd and empty tables."""

import pytest

from tallyforge.llm import registry

NAMES = sorted(registry.queries())
PER_DOCUMENT = {"op1", "op2", "op3", "op4", "op7", "op8", "op12", "op13"}


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, odd_dir, name):
    rows = registry.queries()[name](spark, odd_dir).collect()
    if name.split("_")[0] in PER_DOCUMENT:
        assert len(rows) == 16
    if name.startswith("op9"):
        assert len(rows) == 9
    if name.startswith("op5"):  # the passage of the repeated item stands in one document, once per item
        assert sorted((r.doc_id, r.item_id) for r in rows) == [(7, 1), (7, 1)]
    if name.startswith("op6"):
        placed = {}
        for r in rows:
            placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len([r for r in rows if r.piece == 0]) == 16
        for p in placed.values():
            assert [o for o, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:k]) for k in range(len(p))] and sum(n for _, n in p) <= 1024
    if name.startswith("op8") or name.startswith("op12"):  # copies in other case, the long pair, empty texts by themselves
        got = {(r.doc_id, r.component_id) for r in rows}
        assert {(1, 1), (6, 1), (11, 1), (4, 4), (5, 4), (2, 2), (3, 3), (9, 9), (10, 10)} <= got and {r.n_shingles for r in rows if r.doc_id in (2, 3, 9)} == {0}
        assert {r.n_shingles for r in rows if r.doc_id in (8, 10, 12)} == {1}
    if name.startswith("op13"):
        none = [r for r in rows if r.doc_id in (2, 3)] + [r for r in rows if r.doc_id is None and not r.n_a]
        assert len(none) == 3 and all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "") for r in none)
        assert all(r.n_groups <= min(r.n_a, r.n_b) and r.n_links == r.n_a + r.n_b - r.n_groups and r.n_best <= r.n_links <= r.count_sum and len(r.groups_sha256) == 64 for r in rows if r.n_a)
        assert len({tuple(r)[1:] for r in rows if r.doc_id in (4, 5)}) == 1
    if name.startswith("op11"):  # only the long texts say anything often enough
        assert {r.lang for r in rows} <= {"en", "fr", "und"} and all(r.a >= 100 and r.n >= r.l >= r.a and r.r >= r.a for r in rows)
    if name.startswith("op10"):  # copies of the long text and of the first one; the null id owns nothing
        assert {r.doc_id for r in rows} == {5, 6} and all(r.owner_ids for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty_dir, name):
    assert registry.queries()[name](spark, empty_dir).count() == 0
