import random

from spanlake.plans.spec import TS_ASC, QuerySpec
from spanlake.plans.zones import Overlap, Zone, alone, disjoint, hiders, may_match, newest_until, plan_files

Z = Zone("f", 1, 2, 10, 0, 100, 200, "a", "b", 1, 2, labels={"grade": ["x"], "user": None}, numerics={"load": [5.0, 50.0], "bad": None})


def test_truth_table():
    no = [QuerySpec(time_range=(300, 400)), QuerySpec(labels={"grade": "y"}), QuerySpec(labels={"nope": "x"}), QuerySpec(ranges={"load": (100, 900)}), QuerySpec(ranges={"bad": (0, 9)}), QuerySpec(key_prefix="z"), QuerySpec(after=(99, "k")), QuerySpec(order_by=TS_ASC, after=(201, "k"))]
    yes = [QuerySpec(time_range=(150, 250)), QuerySpec(ranges={"load": (10, 60)}), QuerySpec(key_prefix="a"), QuerySpec(labels={"user": "u1"}), QuerySpec(labels={"grade": "x"}), QuerySpec(after=(100, "k")), QuerySpec(order_by=TS_ASC, after=(200, "k"))]
    assert not any(may_match(Z, s) for s in no) and all(may_match(Z, s) for s in yes)


def zone(k, low, high, seq, labels=(), **more):
    return Zone(f"f{k}", k, 1, 1, 0, 0, 9, low, high, *((seq, seq) if isinstance(seq, int) else seq), labels={"s": list(labels)}, **more)


def test_files_that_hide_are_read():
    old, new, far = zone(1, "a", "c", 1, ["live"]), zone(2, "b", "d", 2, ["gone"]), zone(3, "x", "z", 3, ["gone"])
    spec = QuerySpec(labels={"s": "live"})
    assert plan_files([old, new, far], spec) == ([old], [new])
    assert plan_files([zone(1, "a", "c", 5, ["live"]), new, far], spec)[1] == []
    assert plan_files([old, zone(2, "b", "d", 2, ["gone"], has_incr=True)], spec)[1] == [] and len(plan_files([old, zone(2, "b", "d", 2, ["gone"], has_incr=True)], spec)[0]) == 2


def overlap(a, b):
    return a.min_key <= b.max_key and b.min_key <= a.max_key


def test_choices_are_those_of_all_pairs():
    rng = random.Random(3)
    for _ in range(300):
        zones = []
        for k in range(rng.randrange(1, 14)):
            a, b, s, t = *sorted(rng.choices("abcdefghij", k=2)), *sorted(rng.choices(range(20), k=2))
            zones.append(zone(k, a, b, (s, t)))
        cut = rng.randrange(len(zones) + 1)
        read, rest = zones[:cut], zones[cut:]
        assert hiders(rest, read) == [z for z in rest if any(overlap(z, r) and z.max_seq > r.min_seq for r in read)]
        assert [Overlap(read)(z) for z in rest] == [any(overlap(z, r) for r in read) for z in rest]
        assert alone(zones) == {z.id for z in zones if not any(o.id != z.id and overlap(o, z) for o in zones)}


def test_disjoint():
    assert disjoint([zone(1, "c", "d", 1), zone(2, "a", "b", 2)]) and not disjoint([zone(1, "a", "c", 1), zone(2, "c", "d", 2)])


def test_newest_until():
    z = [Zone(f"f{k}", k, 1, 1, 0, 0, t, "a", "b", k, k) for k, t in enumerate((5, 9, 7))]
    assert [x.max_ts for x in newest_until(z, 2)[0]] == [9, 7] and newest_until(z, 2)[1] == 5 and newest_until(z, 3)[1] is None
