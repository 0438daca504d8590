import random
from collections import Counter

from signloom.llm import term_counts as T


def test_counts_match_however_heavy(spark):
    rng = random.Random(1)
    lists = [["要"] * rng.randint(0, 2) + [rng.choice(["甲", "乙", "x", " ", "", None, "　", "長" * 3000])] + [f"t{rng.randint(0, 40)}"] for _ in range(500)] + [None, []]
    df = spark.createDataFrame([(g, 1, 2) for g in lists], "gloss array<string>, term int, occurrences int").repartition(3)
    own = [[t for t in g or [] if t and t.strip()] for g in lists]
    occurrences, records = Counter(t for g in own for t in g), Counter(t for g in own for t in set(g))
    for heavy in (None, [], ["要"], ["要", "甲", "never", "t1"]):
        got = {r["term"]: (r["occurrences"], r["records"]) for r in T.count_terms(df, "gloss", heavy).collect()}
        assert got == {t: (occurrences[t], records[t]) for t in occurrences}


def test_marks(spark, rows):
    df = spark.createDataFrame([(["a", "b"],)] * 3 + [(["b"],)] * 10 + [(["c", "c"],)] + [(["d"],)] * 2 + [([],)] * 20, "gloss array<string>")
    assert rows(T.mark_terms(df, "gloss").select("term", "mark")) == [("a", None), ("b", "common"), ("c", "rare"), ("d", "rare")]
    assert T.mark_terms(df.limit(0), "gloss").count() == 0


def test_blank_is_one_class(spark, rows):
    blank = ["", " ", "\t", "\n", "\x0b", "\x0c", "\r", "\x85", "\xa0", "\u1680", "\u2007", "\u2028", "\u202f", "\u205f", "\u3000", " \u3000\t"]
    terms = ["\x1c", "\x1f", "\u200b", "\ufeff", "a b"]
    df = spark.createDataFrame([(blank + terms,)], "g array<string>")
    assert sorted(T.heavy_terms(df, "g")) == sorted(terms)
    assert rows(T.count_terms(df, "g", heavy=["a b"])) == rows(T.count_terms(df, "g", heavy=blank + terms)) == sorted(((t, 1, 1) for t in terms), key=repr)
