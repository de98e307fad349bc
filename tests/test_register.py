"""The entity register against a full recluster after random merges and reversals."""

import random

import pytest

from tallyforge.operators import entity
from tallyforge.operators.register import EntityRegister

LINK, PAIR = "a string, b string, confidence double, signals array<string>", "a string, b string"


class Plain:
    """Links in force and what has been cut, by hand."""

    def __init__(self):
        self.links, self.cut, self.audit = {}, set(), []

    def take(self, merges, reversals):
        given = {}
        for a, b, c, _ in merges:
            if a and b and a != b:
                p = (min(a, b), max(a, b))
                given[p] = max(c, given.get(p, 0))
        undone = {(min(p), max(p)) for p in reversals}
        for p, c in given.items():
            if p not in self.cut:
                if p not in self.links and p not in undone:
                    self.audit.append(("merge", *p))
                self.links[p] = c
        for p in undone:
            if p in self.links:
                del self.links[p]
                self.cut.add(p)
                self.audit.append(("reverse", *p))

    def members(self):
        root = {x: x for p in self.links for x in p}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in self.links:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        return sorted((x, find(x)) for x in root)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_a_full_recluster(spark, tmp_path, seed):
    rng, plain, register = random.Random(seed), Plain(), EntityRegister(spark, str(tmp_path / "r"), partitions=4)
    names = [f"n{i:02d}" for i in range(24)]
    for batch in range(4):
        merges = [(*rng.sample(names, 2), rng.choice([0.85, 0.9, 0.97]), ["bridge"]) for _ in range(7)] + [(None, "n01", 0.9, None), ("n02", "n02", 0.9, [])]
        known = list(plain.links) + [(a, b) for a, b, _, _ in merges[:2]]
        reversals = rng.sample(known, min(3, len(known))) + [("zz", "yy")]
        plain.take(merges, reversals)
        for _ in range(1 + (batch == 2)):
            register.take(spark.createDataFrame(merges, LINK), spark.createDataFrame(reversals, PAIR), at=100 + batch, batch=batch)
        got = sorted(map(tuple, register.members.read().select("address", "entity_id").collect()))
        assert got == plain.members() == sorted((r.address, r.entity_id) for r in register.groups.read().collect())
    assert sorted((r.action, r.address_a, r.address_b) for r in register.audit.read().collect()) == sorted(plain.audit)
    by_log = sorted((r.address, r.entity_id, r.since) for r in entity.merge_audit(register.log.read()).collect())
    assert by_log == sorted((r.address, r.entity_id, r.since) for r in register.members.read().collect())
    want = {}
    entity_of = dict(plain.members())
    for (a, _), c in plain.links.items():
        e = want.setdefault(entity_of[a], [0, 1.0])
        e[1] = min(e[1], c)
    for x in entity_of.values():
        want[x][0] += 1
    assert {r.entity_id: [r.member_count, r.cohesion] for r in register.entities().collect()} == want


@pytest.mark.parametrize("lost", ["members", "groups", "audit", "log"])
def test_a_lost_batch_is_completed(spark, tmp_path, lost):
    register = EntityRegister(spark, str(tmp_path / "r"), partitions=2)
    link = lambda *pairs: spark.createDataFrame([(a, b, 0.9, ["x"]) for a, b in pairs], LINK)
    none = spark.createDataFrame([], PAIR)
    register.take(link(("b", "c"), ("d", "e")), none, at=1, batch=0)
    store = getattr(register, lost)
    verbs = {v: getattr(store, v) for v in ("merge", "append")}
    for v in verbs:
        setattr(store, v, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    change = (link(("a", "d")), spark.createDataFrame([("b", "c")], PAIR))
    with pytest.raises(RuntimeError):
        register.take(*change, at=2, batch=1)
    for v, f in verbs.items():
        setattr(store, v, f)
    register.take(*change, at=2, batch=1)
    assert sorted(map(tuple, register.members.read().collect())) == [("a", "a", 2), ("d", "a", 2), ("e", "a", 2)]
    assert sorted((r.entity_id, r.address, r.action, r.at) for r in register.log.read().where("at = 2").collect()) == [("a", "a", "joined", 2), ("a", "d", "joined", 2), ("a", "e", "joined", 2), ("b", "b", "removed", 2), ("b", "c", "removed", 2), ("d", "d", "removed", 2), ("d", "e", "removed", 2)]
    assert sorted((r.entity_id, r.action, r.address_a, r.address_b) for r in register.audit.read().where("at = 2").collect()) == [("a", "merge", "a", "d"), ("b", "reverse", "b", "c")]


def test_untouched_entities_are_left(spark, tmp_path):
    register = EntityRegister(spark, str(tmp_path / "r"), partitions=64)
    link = lambda *pairs: spark.createDataFrame([(a, b, 0.9, ["x"]) for a, b in pairs], LINK)
    none = spark.createDataFrame([], PAIR)
    register.take(link(*((f"p{i}", f"q{i}") for i in range(20))), none, at=1, batch=0)
    before = register.members.version()
    register.take(link(("p3", "p7")), none, at=2, batch=1)
    now = register.members.version()
    assert len([p for p in now.parts if now.parts[p] != before.parts.get(p)]) <= 2  # p7 and q7 moved to p3
    assert {r.address for r in register.members.read().where("since = 2").collect()} == {"p7", "q7"}
    register.take(link(("p3", "p7")).limit(0), none, at=3, batch=2)
    assert register.members.read().count() == 40
