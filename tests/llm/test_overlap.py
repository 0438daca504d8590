import random

from signloom.llm import overlap as O


def grams(t):
    return {a + b for a, b in zip(t, t[1:])}


def alike(a, b):
    x, y = grams(a), grams(b)
    return bool(x and y) and len(x & y) >= 0.7 * len(x | y) - 1e-9


def brute(rows):
    plain = lambda t: "".join(c for c in t if c.isalnum()).lower()
    out = set()
    for i, s, c, g in rows:
        for j, u, d, h in rows:
            if i and j and s != "train" and u == "train" and any(x and y and alike(plain(x), plain(y)) for x, y in ((c, d), (g, h))):
                out.add((i, j))
    return out


SCHEMA = "id string, split string, chinese string, gloss_text string, tid string, text string"


def pairs(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    return {tuple(r) for r in O.cross_split_pairs(df, "id", "split", ["chinese", "gloss_text"]).collect()}


def test_edges(spark):
    rows = [
        ("e1", "dev", "我今天去圖書館借了三本書。", None), ("t1", "train", "我今天去圖書館借了三本書", "x"), ("e2", "test", None, "甲/乙/丙/丁/戊/己/庚"), ("t2", "train", "", "甲乙丙丁戊己庚"), ("e3", None, "a", "b"), ("t3", "train", "a", "b"),
        ("e4", "test_corpus", "", ""), ("t4", "train", "", ""), (None, "train", "我今天去圖書館借了三本書", None), ("e1", "dev", "我今天去圖書館借了三本書。", None), ("e5", "dev", "長短" * 6000 + "好", None), ("t5", "train", "長短" * 6000 + "壞", None),
    ]
    assert pairs(spark, rows) == brute(rows) == {("e1", "t1"), ("e2", "t2"), ("e5", "t5")} & brute(rows)


def test_matches_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(chr(0x4E00 + rng.randint(0, 300)) for _ in range(rng.randint(20, 40)))
    bases = [word() for _ in range(60)]
    rows = []
    for n in range(500):
        t = list(rng.choice(bases))
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = chr(0x4E00 + rng.randint(0, 300))
        rows.append((f"r{n:03}", rng.choice(["train", "train", "dev", "test"]), "".join(t), word() if rng.random() < 0.9 else rng.choice(bases)))
    got, want = pairs(spark, rows), brute(rows)
    assert got <= want
    assert len(want - got) <= 0.002 * len(want), (len(want), want - got)


def test_hot_text(spark):
    rows = [(f"t{n}", "train", "同一句話說了很多遍也不累", None) for n in range(300)] + [("e", "dev", "同一句話說了很多遍也不累！", None)]
    assert len(pairs(spark, rows)) == 300


def test_empty(spark):
    assert O.cross_split_pairs(spark.createDataFrame([], SCHEMA), "id", "split", ["chinese", "gloss_text"]).count() == 0


def test_two_texts_of_one_hash(spark, monkeypatch):
    one = lambda field, text: (O.F.lit(1).cast("long").alias("h"), O.F.xxhash64(field, text).alias("g"))
    monkeypatch.setattr(O, "_hashes", one)
    rows = [("e", "dev", "我今天去圖書館借了三本書", None), ("t", "train", "我今天去圖書館借了三本書。", None), ("u", "train", "他們昨天在操場打了兩場球", None), ("f", "dev", "他們昨天在操場打了兩場球！", None)]
    assert pairs(spark, rows) == brute(rows) == {("e", "t"), ("f", "u")}


def many(seed, n=400):
    rng = random.Random(seed)
    bases = ["".join(chr(0x4E00 + rng.randint(0, 300)) for _ in range(24)) for _ in range(12)]
    rows = []
    for k in range(n):
        t = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(24)] = chr(0x4E00 + rng.randint(0, 300))
        rows.append((f"r{k:03}", rng.choice(["train", "dev", "test", None]), "".join(t), rng.choice([None, "", rng.choice(bases)])))
    return rows


def test_full_bitmap_and_split_buckets_change_nothing(spark, monkeypatch):
    rows = many(6)
    want = pairs(spark, rows)
    assert len(want) > 1000
    monkeypatch.setattr(O, "FILTER_BITS", 12)
    monkeypatch.setattr(O, "BUCKET_PAIRS", 50)
    monkeypatch.setattr(O, "CELL_ROWS", 7)
    splits, made = [], O._grid
    monkeypatch.setattr(O, "_grid", lambda *a: splits.append(made(*a)) or splits[-1])
    assert pairs(spark, rows) == want
    assert len(splits) > 1 and any(g is not None for g in splits)


def test_counts_are_those_of_the_pairs(spark):
    rows = [(i, s, c, g, random.Random(i).choice(["a", "b", None])) for i, s, c, g in many(7, 300)] * 2
    df = spark.createDataFrame(rows, "id string, split string, chinese string, gloss_text string, source string")
    found = O.cross_split_pairs(df, "id", "split", ["chinese", "gloss_text"]).collect()
    of = {r[0]: (r[1], r[4]) for r in rows}
    want = {}
    for a, _ in found:
        n = want.setdefault(of[a], [0, set()])
        n[0] += 1
        n[1].add(a)
    got = {(r["split"], r["source"]): (r["pairs"], r["records"]) for r in O.cross_split_counts(df, "id", "split", "source", ["chinese", "gloss_text"]).collect()}
    assert got == {k: (n, len(x)) for k, (n, x) in want.items()}
    assert O.cross_split_counts(df.limit(0), "id", "split", "source", ["chinese", "gloss_text"]).count() == 0
