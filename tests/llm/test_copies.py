import json

from pyspark.sql import functions as F

from signloom.llm import copies as C

PAIRS = [
    ("b", "你好。", "你/好"), ("a", "你 好", "你／好"), ("c", "你好", "你//好/"), ("d", "你好", "你/好啊"), ("e", None, "你/好"), ("f", "你好", ""), ("g", "Ｃafé", "café"), ("h", "CAFÉ", "CAFÉ"), ("h", "CAFÉ", "CAFÉ"),
    (None, "你好", "你/好"), ("z", "長" * 9000, "長"), ("y", "長，" * 9000, "長 "),
]


def collapsed(rows, **k):
    return {(r["tbl"], r["key"]): (r["rep"], r["copies"]) for r in C.collapse(rows, **k).collect()}


def test_pairs(spark):
    df = spark.createDataFrame([(*p, "x") for p in PAIRS], "id string, chinese string, gloss_text string, canon string")
    rows = C.canonical_pairs(df, "id", "chinese", "gloss_text").withColumn("tbl", F.lit("t"))
    want = {"a": ("a", 3), "b": ("a", 3), "c": ("a", 3), "d": ("d", 1), "g": ("g", 2), "h": ("g", 2), "y": ("y", 2), "z": ("y", 2)}
    for most in (1, 2, 1000):  # every bucket oversized, some, none
        assert collapsed(rows, bucket_rows=most) == {("t", k): v for k, v in want.items()}
    assert C.collapse(rows.limit(0)).count() == 0


def test_objects(spark):
    lines = [
        '{"chinese": "你好。", "gloss_text": "你/好", "n": 1, "nms": null}', '{"nms":null,"n":1,"gloss_text":"你 / 好","chinese":"\\u4f60\\u597d"} \t', '{"chinese": "你好。", "gloss_text": "你/好", "n": 2, "nms": null}',
        '{"chinese": "你好。", "gloss_text": "你/好", "n": "1", "nms": null}', '{"chinese": "你好。", "gloss_text": "你/好", "n": 1}', "null", "[1]", "", " ", '{"chinese": "你', None,
        json.dumps({"chinese": None, "gloss_text": "你", "nms": ["a"]}), json.dumps({"gloss_text": "你", "nms": ["a"], "chinese": None}), json.dumps({"gloss_text": "你", "nms": ["b"], "chinese": None}),
    ]
    df = spark.createDataFrame([(f"L{i:02}", x, 0) for i, x in enumerate(lines)], "line_id string, line string, key int")
    got = collapsed(C.canonical_objects(df, "line_id", "line", "chinese", "gloss_text").withColumn("tbl", F.lit("l")))
    same = {("l", "L00"): ("L00", 2), ("l", "L01"): ("L00", 2), ("l", "L11"): ("L11", 2), ("l", "L12"): ("L11", 2)}
    assert got == same | {("l", f"L{i:02}"): (f"L{i:02}", 1) for i in (2, 3, 4, 13)}


def test_a_hot_text_is_salted(spark):
    rows = spark.createDataFrame([("t", f"k{i:05}", "同一句" if i % 3 else f"句{i}") for i in range(3000)], "tbl string, key string, canon string")
    got = C.collapse(rows, bucket_rows=100)
    hot = got.filter("copies > 1")
    assert hot.count() == 2000 and hot.select("rep", "copies").distinct().collect() == [("k00001", 2000)]
    assert got.filter("copies = 1").count() == 1000


def test_a_long_common_beginning(spark):
    rows = spark.createDataFrame([("t", f"k{i:03}", "同一個開頭" * 400 + str(i // 2)) for i in range(100)], "tbl string, key string, canon string")
    assert collapsed(rows, bucket_rows=5) == {("t", f"k{i:03}"): (f"k{i // 2 * 2:03}", 2) for i in range(100)}


def test_buckets_are_bounded_by_bytes_too(spark):
    long = [("t", f"k{i:02}", "同一個開頭" * 300 + chr(0x4E00 + i // 3) * 2000) for i in range(30)] + [("t", f"m{i}", "一" * 20000) for i in range(4)]
    rows = spark.createDataFrame(long, "tbl string, key string, canon string")
    own = rows.select("tbl", "key", F.encode("canon", "utf-8").alias("bytes"))
    sizes = C.radix_buckets(own, bucket_bytes=50_000).groupBy("tbl", "bucket", F.expr("pmod(xxhash64(key), salts)")).agg(F.sum(F.length("bytes")).alias("b"), F.count("*").alias("n"))
    assert sizes.filter("b > 50000 and n > 1").count() <= 1  # copies that fall on one salt
    want = {("t", f"k{i:02}"): (f"k{i // 3 * 3:02}", 3) for i in range(30)} | {("t", f"m{i}"): ("m0", 4) for i in range(4)}
    assert collapsed(rows, bucket_bytes=50_000) == want
