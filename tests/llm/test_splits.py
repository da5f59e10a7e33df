import random
from collections import defaultdict

from tests.llm.helpers import HISTORY, with_clashes
from threadloom.llm import splits


def rows(spark, triples, split="dev"):
    return spark.createDataFrame([(s, "d", "x", split if not callable(split) else split(s), u, c, ["t"], None) for s, u, c in triples], HISTORY)


def components(triples):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for s, u, c in triples:
        find(("s", s))
        for k, v in (("u", u), ("c", c)):
            if v and v.strip().lower() not in splits.PLACEHOLDERS:
                parent[find(("s", s))] = find((k, v))
    groups = defaultdict(set)
    for s, _, _ in triples:
        groups[find(("s", s))].add(s)
    return {frozenset(g) for g in groups.values()}


def labelled(table):
    groups = defaultdict(set)
    for r in splits.record_splits(table).collect():
        groups[r.component].add(r.sample_id)
    return {frozenset(g) for g in groups.values()}


def test_components_against_union_find_in_batches(spark):
    rng = random.Random(7)
    pick = lambda n, p: None if rng.random() < 0.3 else rng.choice(["unknown", " N/A ", ""]) if rng.random() < 0.1 else f"{p}{rng.randrange(n)}"
    triples = [(f"s{i}", pick(60, "u"), pick(60, "v")) for i in range(150)] + [(f"c{i}", f"chain{i}", f"link{i // 2}") for i in range(12)] + [(f"c{i}", f"chain{i + 1}", None) for i in range(11)]
    whole = splits.update_components(splits.empty_table(spark), rows(spark, triples))
    assert labelled(whole) == components(triples)
    first = splits.update_components(splits.empty_table(spark), rows(spark, triples[:80]))
    assert labelled(splits.update_components(first, rows(spark, triples[80:]))) == components(triples)


def test_existing_splits_stay_and_conflicts_are_quarantined(spark):
    share = {"train": 0.5, "test": 0.5}
    first = splits.assign_splits(rows(spark, [(f"s{i}", f"u{i}", None) for i in range(40)]), share)
    before = {r.sample_id: r.split for r in splits.record_splits(first).collect()}
    assert set(before.values()) == {"train", "test"}
    a = next(s for s in before if before[s] == "train")
    b = next(s for s in before if before[s] == "test")
    c = next(s for s in before if before[s] == "test" and s != b)
    batch = rows(spark, [(a, None, "bridge"), (b, None, "bridge"), ("new1", "u" + c[1:], None), ("new2", "fresh", None)])
    after = {r.sample_id: r for r in splits.record_splits(splits.assign_splits(batch, share, first)).collect()}
    assert after[a].quarantined and after[b].quarantined and after[a].split is None
    assert after["new1"].split == before[c] and after["new2"].split in share
    assert all(after[s].split == before[s] for s in before if s not in (a, b))
    later = splits.update_components(splits.assign_splits(batch, share, first), rows(spark, [("new3", None, "bridge")]))
    assert {r.sample_id: r.quarantined for r in splits.record_splits(later).collect()}["new3"]


def test_a_hub_and_proportions(spark):
    triples = [(f"h{i}", "hub", None) for i in range(300)] + [(f"s{i}", None, None) for i in range(700)]
    got = splits.record_splits(splits.assign_splits(rows(spark, triples), {"train": 0.8, "validation": 0.1, "test": 0.1})).collect()
    assert len({r.split for r in got if r.sample_id.startswith("h")}) == 1
    n = defaultdict(int)
    for r in got:
        n[r.split] += 1
    assert 740 < n["train"] < 860 and 50 < n["validation"] < 150


def test_stored_table_over_batches(spark, tmp_path):
    share = {"train": 0.8, "validation": 0.1, "test": 0.1}
    stored = splits.ComponentTable(spark, str(tmp_path / "table"))
    assert stored.read().count() == 0
    triples = [(f"s{i}", f"u{i // 3}", None) for i in range(300)]
    stored.add(rows(spark, triples[:150]), share, "one")
    before = {r.sample_id: r.split for r in splits.record_splits(stored.read()).collect()}
    stored.add(rows(spark, triples[150:] + [("late", "u1", None)]), share, "two")
    stored.add(rows(spark, [("never", "u1", None)]), share, "two")
    again = splits.ComponentTable(spark, str(tmp_path / "table")).read()
    after = {r.sample_id: r.split for r in splits.record_splits(again).collect()}
    assert len(after) == 301 and "never" not in after and after["late"] == after["s3"]
    assert all(after[s] == before[s] for s in before)
    for i in range(100):
        assert len({after[f"s{3 * i + k}"] for k in range(3)}) == 1
    n = defaultdict(int)
    for v in after.values():
        n[v] += 1
    assert abs(n["train"] - 241) <= 4 and abs(n["validation"] - 30) <= 4 and abs(n["test"] - 30) <= 4


def test_shares_hold_with_components_of_all_sizes(spark):
    rng = random.Random(2)
    triples, at = [], 0
    for u, size in enumerate([120, 90, 60, 33, 30, 20] + [rng.randrange(1, 9) for _ in range(150)]):
        triples += [(f"s{at + i}", f"u{u}", None) for i in range(size)]
        at += size
    share = {"train": 0.6, "validation": 0.2, "test": 0.2}
    got = splits.record_splits(splits.assign_splits(rows(spark, triples), share)).collect()
    n = defaultdict(int)
    for r in got:
        n[r.split] += 1
    assert all(abs(n[s] - p * len(got)) <= 0.03 * len(got) for s, p in share.items()), dict(n)


def test_conflicts_nulls_repeats_clashes(spark):
    triples = [("a", "x", None), ("b", "x", None), ("c", None, "k"), ("c", None, "k"), ("d", "unknown", None), ("e", "Unknown ", None), (None, "x", "k"), ("f", "X", None)]
    where = {"a": "dev", "b": "heldout", "c": "dev", "d": "dev", "e": "heldout", "f": "validation"}
    records = with_clashes(rows(spark, triples, split=where.get))
    assert {r.sample_id for r in splits.split_conflicts(records).collect()} == {"a", "b"}
    torn = rows(spark, [("t", None, None)]).unionByName(rows(spark, [("t", None, None)], split="heldout"))
    assert [r.sample_id for r in splits.split_conflicts(torn).collect()] == ["t"]
    assert splits.split_conflicts(records.limit(0)).count() == 0
    assert splits.assign_splits(records.limit(0), {"train": 1.0}).count() == 0
