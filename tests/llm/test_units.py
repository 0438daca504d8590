import random

from signloom.llm import units as U


def brute(records, segments):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    ids = {r[0] for r in records if r[0]}
    import re

    for i, g in records:
        if i:
            find(i)
            if g and g.strip():
                parent[find(i)] = find("g:" + g.strip().lower())
    for i, s, c in segments:
        if i in ids:
            if s and re.sub(r"p\d+$", "", s.strip().lower()):
                parent[find(i)] = find("d:" + re.sub(r"p\d+$", "", s.strip().lower()))
            if c and c.split("/")[0].strip():
                parent[find(i)] = find("c:" + c.strip().lower().split("/")[0])
    least = {}
    for i in sorted(ids):
        least.setdefault(find(i), i)
    return {i: least[find(i)] for i in ids}


R, S = "id string, group_key string, unit string, entity string", "id string, seg_uuid string, corpus_id string, node int"


def test_ties(spark):
    records = [("a", "G1"), ("b", " g1 "), ("c", None), ("d", ""), ("e", "G2"), ("f", None), ("f", None), (None, "G1"), ("g", "G9")]
    segments = [("b", "d1P1", "1/1"), ("c", " D1p22", "2/1"), ("e", None, "2/7"), ("e", None, "2/7"), ("x", "d1P3", "3/1"), ("g", "P3", " "), (None, "d1P1", "3/2")]
    df, seg = spark.createDataFrame([(*r, "u", "e") for r in records], R), spark.createDataFrame([(*s, 0) for s in segments], S)
    got = {r["id"]: r["unit"] for r in U.units(df, seg).collect()}
    assert got == brute(records, segments) == {"a": "a", "b": "a", "c": "a", "e": "a", "d": "d", "f": "f", "g": "g"}
    assert U.units(df.limit(0), seg).count() == 0
    assert {r["unit"] for r in U.units(df, seg.limit(0)).collect()} == {"a", "c", "d", "e", "f", "g"}


def test_random_graphs_and_a_long_chain(spark):
    rng = random.Random(9)
    records = [(f"r{i:03}", f"g{rng.randint(0, 150)}") for i in range(200)] + [(f"chain{i:03}", f"x{(i + 1) // 2}") for i in range(80)]
    segments = [(f"r{i:03}", f"d{rng.randint(0, 120)}P{i}", f"{rng.randint(0, 300)}/1") for i in range(200)] + [(f"chain{i:03}", f"y{i // 2}P1", None) for i in range(80)]
    df, seg = spark.createDataFrame([(*r, "", "") for r in records], R), spark.createDataFrame([(*s, 0) for s in segments], S)
    assert {r["id"]: r["unit"] for r in U.units(df, seg).collect()} == brute(records, segments)


def test_assignment_keeps_units_and_shares(spark):
    rng = random.Random(2)
    rows = [(f"i{n}", f"u{rng.randint(0, 600)}") for n in range(4000)] + [(f"h{n}", "hot") for n in range(1500)]
    placed = spark.createDataFrame(rows, "id string, unit string")
    labels = spark.createDataFrame([(i, "ab"[n % 2] if n % 7 else None) for n, (i, _) in enumerate(rows)], "id string, label string")
    shares = spark.createDataFrame([("train", 0.8), ("dev", 0.08), ("test", 0.12)], "split string, share double")
    got = U.assign(placed, labels, shares).collect()
    assert len(got) == len(rows)
    by_unit = {}
    for r in got:
        assert by_unit.setdefault(r["unit"], r["split"]) == r["split"]
    for s, share in (("train", 0.8), ("dev", 0.08), ("test", 0.12)):
        assert abs(sum(r["split"] == s for r in got) / len(rows) - share) < 0.01
    assert {r["split"] for r in U.assign(placed, labels, shares.limit(0)).collect()} == {None}
    assert U.assign(placed.limit(0), labels, shares).count() == 0


def test_every_label_however_rare_is_spread_by_the_shares(spark):
    rng = random.Random(5)
    units = [(f"u{n}", n % 100, rng.randint(1, 4)) for n in range(9000)]
    rows = [(f"{u}-{k}", u, f"label{x}") for u, x, size in units for k in range(size)] + [(f"one{n}", f"one{n}", f"single{n}") for n in range(500)]
    df = spark.createDataFrame(rows, "id string, unit string, label string")
    given = {"train": 0.8, "dev": 0.08, "test": 0.12}
    got = U.assign(df.select("id", "unit"), df.select("id", "label"), spark.createDataFrame([*given.items()], "split string, share double")).collect()
    of, label = {r["id"]: r["split"] for r in got}, {i: x for i, _, x in rows}
    assert len(got) == len(of) == len(rows)
    assert len({(u, of[i]) for i, u, _ in rows}) == len({u for _, u, _ in rows})
    for s, share in given.items():
        for x in range(100):
            own = [i for i in of if label[i] == f"label{x}"]
            assert abs(sum(of[i] == s for i in own) / len(own) - share) < 0.06, (s, x)
        single = [i for i in of if label[i].startswith("single")]
        assert abs(sum(of[i] == s for i in single) / len(single) - share) < 0.06
