import random

from signloom.llm import canonical as C


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


MASTER = "gloss_id long, surface string, aliases array<string>, extra int"


def test_typed_tokens(spark, rows):
    master = spark.createDataFrame([(1, "圖書館", ["書館"], 0), (2, "Brigaizax", [], 0), (3, "好", None, 0), (4, "Zoélle", [], 0)], MASTER)
    glosses = ["圖書館", " 圖書館", "圖書館_A", "圖書館_B++", "書館", "BRIGAIZAX", "brig-aizax", "Brigiazax", "「Zoélle」", "zzzzz", None, " ", "＿＿", "圖書", "好？", "？？"]
    df = spark.createDataFrame([("r", glosses, 1), ("s", None, 1), ("t", [], 1), (None, ["書館"], 1)], "id string, gloss array<string>, token int")
    got = {r["pos"]: r["gloss_id"] for r in C.map_tokens(df.filter("id = 'r'"), "id", "gloss", master).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 2, 7: 2, 8: 4, 9: -1, 13: 1, 14: 3, 15: -1}
    assert rows(C.map_tokens(df.filter("id is null"), "id", "gloss", master)) == [(None, 0, 1)]
    assert C.map_tokens(df.limit(0), "id", "gloss", master).count() == 0
    assert rows(C.map_tokens(df.filter("id is null"), "id", "gloss", master.limit(0))) == [(None, 0, -1)]


def test_pigeonhole_loses_nothing(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    names = sorted({word(rng.randint(1, 12)) for _ in range(60)})
    values = sorted({word(rng.randint(1, 14)) for _ in range(250)} | {n[:i] + rng.choice("abcd") + n[i + 1 :] for n in names for i in (0, len(n) // 2)} - {""})
    master = spark.createDataFrame([(i, n, []) for i, n in enumerate(names)], "gloss_id long, surface string, aliases array<string>")
    got = {r["value"]: r["entry"] for r in C.map_values(spark.createDataFrame([(v,) for v in values], "v string"), "v", master, "gloss_id", "surface", "aliases").collect()}
    for v in values:
        if v in names:
            assert v not in got
            continue
        near = [(lev(v, n), i) for i, n in enumerate(names) if lev(v, n) <= max(len(v), len(n)) // 3]
        assert got[v] == (min(near)[1] if near else -1), v


def test_ties_go_to_the_smallest_entry(spark, rows):
    master = spark.createDataFrame([(9, "abcx", []), (4, "abcy", [])], "gloss_id long, surface string, aliases array<string>")
    values = spark.createDataFrame([("abcz",), ("abcz",), (None,), ("x" * 5000,)], "v string")
    assert rows(C.map_values(values, "v", master, "gloss_id", "surface", "aliases")) == [("abcz", 4), ("x" * 5000, -1)]
