import random
import re

import pytest
from pyspark.sql import functions as F

from signloom.functions import arrays, text


def values(spark, column, data, schema="x string"):
    df = spark.createDataFrame([(d,) for d in data], schema).withColumn("__i", F.monotonically_increasing_id())
    return [r["y"] for r in df.coalesce(1).orderBy("__i").select(column.alias("y")).collect()]


def test_tokens_keep_inner_space_and_drop_blank_ones(spark):
    data = ["甲/乙", "甲／ 乙 /", "", "　/ / ", None, "甲//乙"]
    assert values(spark, text.tokens("x"), data) == [["甲", "乙"], ["甲", " 乙 "], [], [], None, ["甲", "乙"]]


def test_names_and_tokens(spark):
    assert values(spark, text.base_name("x"), ["好_A", "好_AB2", "好_ABC", "_A", None]) == ["好", "好", "好_ABC", "_A", None]
    assert values(spark, text.variant_of("x"), ["好_A", "好_a1", "好", ""]) == ["A", "a1", None, None]
    assert values(spark, text.clean_token("x"), ["「好」，了　++", "。", None]) == ["好了++", "", None]
    assert values(spark, text.words_between_marks("x"), ["甲，乙。丙 ?", "", None]) == [["甲", "乙", "丙"], [], None]
    assert values(spark, text.norm_variants("x"), ["臺着菸祐台"]) == ["台著煙佑台"]
    assert values(spark, text.slash_parts("x"), ["甲//乙/"]) == [["甲", "乙"]]


PREDICTIONS = [
    ("Gloss：甲/乙", "甲/乙"), ("`甲／乙`", "甲/乙"), ("「甲/乙」", "甲/乙"), ("甲 / 乙。", "甲/乙"), ("甲/乙（規則2）", "甲/乙"), ("甲/乙（規則2）。", "甲/乙（規則2）"), ("說明：\n甲/乙\n丙/丁", "甲/乙"), ("\n好\n\n很好！\n", "很好"), ("", ""), (None, ""), ("　 ", ""), ("gloss: 'a/b'", "a/b"), ("TSL：甲", "甲"),
]


def test_parse_prediction(spark):
    assert values(spark, text.parse_prediction("x"), [r for r, _ in PREDICTIONS]) == [w for _, w in PREDICTIONS]


def test_group_key_falls_back_past_empty_values(spark):
    rows = [("tslcorpus", "i", "u-1P3", "9/1", None, None), ("tslcorpus", "i", "", "9/1", None, None), ("tslcorpus", "i", None, "", None, None), ("twtsl-sentence", "i", None, None, "", None), ("synth", "i", None, None, None, "T1"), ("real", "i", None, None, None, None)]
    df = spark.createDataFrame(rows, "s string, i string, d string, c string, h string, t string")
    got = [r[0] for r in df.coalesce(1).select(text.group_key("s", "i", "d", "c", "h", "t")).collect()]
    assert got == ["corpus:u-1", "corpus:9", "corpus:i", "twtsl:i", "synth:T1", "real:i"]


def test_small_text_functions(spark):
    assert values(spark, text.prefixed_url("x", "http://h"), ["/a", "a", None]) == ["http://h/a", "a", None]
    assert values(spark, text.numbered("TC", 3, "x"), [7, 12345], "x int") == ["TC007", "TC12345"]
    assert values(spark, text.id_number("x", 3), ["SYN0012", "SYNx", None]) == [12, None, None]
    assert values(spark, text.filled("x", P=F.lit(None).cast("string"), T=F.lit("今天")), ["{T}有{P}"]) == ["今天有"]
    assert values(spark, text.banner("x", F.lit("新")), ["頭｜舊"]) == ["頭｜新"]
    assert values(spark, text.scalar_or_list("x"), [None, [], ["a"], ["a", "b"]], "x array<string>") == ["null", "null", '"a"', '["a","b"]']
    assert values(spark, text.list_or_words("x"), ['["甲","乙 "]', '"甲／乙 丙"', "null", "{broken", None]) == [["甲", "乙 "], ["甲", "乙", "丙"], [], [], []]
    assert values(spark, text.first_true("x", F.lit("z")), ["", None, "a"]) == ["z", "z", "a"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_longest_common_subsequence(spark):
    rng = random.Random(0)
    some = lambda n: [rng.choice("abcd") for _ in range(rng.randint(0, n))]
    pairs = [(some(15), some(15)) for _ in range(60)] + [(some(90), some(90)) for _ in range(6)] + [([], ["a"]), (["a"], []), (["a"] * 60, ["a"] * 60), (["a"] * 61, ["a"] * 61)]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>").coalesce(1)
    assert [r[0] for r in df.select(arrays.longest_common(F.col("a"), F.col("b"))).collect()] == [lcs(a, b) for a, b in pairs]


def test_clipped_matches_and_ngrams(spark):
    pairs = [(["a", "a", "b"], ["a", "a", "a", "c"]), ([], ["a"]), (["a"], []), (["x", "y"], ["y", "x"])]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>").coalesce(1)
    assert [r[0] for r in df.select(arrays.clipped_matches(F.col("a"), F.col("b"))).collect()] == [2, 0, 0, 2]
    assert [len(r[0]) for r in df.select(arrays.ngrams(F.col("b"), 2)).collect()] == [3, 0, 0, 1]


def test_array_functions(spark):
    assert values(spark, arrays.last_match(F.col("x"), ["要"]), [["要", "好", "不要"], ["好"], []], "x array<string>") == [2, None, None]
    assert values(spark, arrays.without(F.col("x"), "＿"), [["甲", "乙＿"]], "x array<string>") == [["甲"]]
    df = spark.createDataFrame([([1, 2], [1, 2, 3, 4]), ([1, 2], [1]), ([], [5])], "p array<int>, w array<int>").coalesce(1)
    assert [r[0] for r in df.select(arrays.masked_labels(F.col("p"), F.col("w"), 3)).collect()] == [[-100, -100, 3], [-100, -100], [5]]
    assert values(spark, arrays.padded(F.col("x"), F.lit(3), 0), [[1]], "x array<int>") == [[1, 0, 0]]
    assert values(spark, arrays.values_of_keys(F.col("x"), "lo", "_hs"), [{"lo2_hs1": "b", "lo1_hs1": "a", "lo3": "c", "lo4_hs": ""}], "x map<string,string>") == [["a", "b"]]


@pytest.mark.parametrize("pattern", [text.SPACE, text.LINE_BREAK])
def test_classes_equal_those_of_python(spark, pattern):
    points = [chr(c) for c in (*range(1, 0x3100), 0xFEFF) if not 0xD800 <= c < 0xE000]
    got = values(spark, F.col("x").rlike(f"^(?:[{pattern}])$" if pattern == text.SPACE else f"^(?:{pattern})\\z"), [f"{c}" if c not in "\n\r" or pattern != text.SPACE else c for c in points])
    want = [c.isspace() for c in points] if pattern == text.SPACE else [len(f"a{c}b".splitlines()) > 1 for c in points]
    assert [hex(ord(c)) for c, g, w in zip(points, got, want, strict=True) if g != w and c not in "\n\r"] == []
    assert re.fullmatch(r"\s", " ")
