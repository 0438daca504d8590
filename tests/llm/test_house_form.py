import random
import re
import unicodedata

from pyspark.sql import functions as F

from signloom.llm import house_form as H

CASES = [
    ("ｃａｆé", "café"), ("café", "café"), ("e​́t", "ét"), ("⼤⼩", "大小"), ("蘭花", "蘭花"), ("甲／乙⁄丙∕丁", "甲/乙/丙/丁"),
    ("a b　c", "a b c"), ("清​晨﻿", "清晨"), ("兒‍童", "兒童"), ("👩‍🏫。", "👩‍🏫。"), ("❤️", "❤️"), ("上︀午\U000e0100", "上午"),
    ("Rеngοtrх", "Rengotrx"), ("ζητον", "ζητον"), ("Ладора", "Ладора"), ("カフェ", "カフェ"), ("你好｡", "你好。"), ("你好､我", "你好、我"), ("好,嗎?", "好，嗎？"),
    ("大夫_A/去", "大夫_A/去"), ("大夫_B++/去", "大夫_B++/去"), ("__有", "＿＿有"), ("＿＿", "＿＿"), ("a\tb\n c  d", "a\tb\n c  d"), ("", ""), (None, None), ("\u2ed1\u2edd", "長食"),
    ("ấ", "ấ"), ("ấ", "ấ"), ("ậ", "ậ"), ("Ångro", "Ångro"), ("が", "が"), ("q́", "q́"),
]


def test_cases_and_extra_columns(spark):
    df = spark.createDataFrame([(i, t, "x", 7) for i, (t, _) in enumerate(CASES)], "id int, text string, house string, __seg int")
    got = {r["id"]: r["out"] for r in H.house_form(df, ["id"], "text", "out").collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


def test_disguised_names_record_and_field(spark, rows):
    df = spark.createDataFrame([("1", "好", "甲/乙"), ("2", "ｃ", "甲／乙"), ("2", "ｃ", "甲／乙"), (None, "⼤", None), ("4", None, "")], "id string, chinese string, gloss_text string")
    assert rows(H.disguised(df, "id", ["chinese", "gloss_text"])) == [("2", "chinese"), ("2", "gloss_text"), (None, "chinese")]
    assert H.disguised(df.limit(0), "id", ["chinese", "gloss_text"]).count() == 0


def test_long_and_random_texts_match_a_plain_version(spark):
    rng = random.Random(5)
    parts = ["好", "天", "é", "é", "ñ", "ｚ", "Z", "​", "﻿", "⼤", "說", "／", "/", "，", "。", " ", " ", "ο", "а", "αβ", "K", "ёж", "🙂"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(400)] + ["⼤好é" * 5000]
    drop = set(H.INVISIBLE)

    def plain(t):
        t = "".join(c for c in t if c not in drop)
        t = "".join("/" if c in "／⁄∕" else c if c in "，。？！：；、（）「」＿" else unicodedata.normalize("NFKC", c) for c in t)
        t = unicodedata.normalize("NFC", t)
        latin = lambda w: unicodedata.normalize("NFC", "".join(H.LOOK_ALIKE.get(c, c) for c in unicodedata.normalize("NFD", w)))
        mixed = lambda m: latin(m.group()) if re.search("[A-Za-zÀ-ɏ]", m.group()) else m.group()
        return re.sub("[A-Za-zÀ-ɏͰ-ϿЀ-ԯ̀-ͯ]+", mixed, t)

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r["id"]: r["house"] for r in H.house_form(df, ["id"], "text").collect()}
    wrong = [(t, got[i], plain(t)) for i, t in enumerate(texts) if got[i] != plain(t)]
    assert not wrong, wrong[:3]


def test_columns_keep_rows_with_nulls(spark, rows):
    df = spark.createDataFrame([("1", None, "ａ"), ("2", "", "b"), ("3", "ｃ", None), ("3", "ｃ", None), ("4", "d", ""), ("4", "d", "")], "id string, a string, b string")
    assert rows(H.house_columns(df, {"a": "ah", "b": "bh"}).select("id", "ah", "bh")) == [("1", None, "a"), ("2", "", "b"), ("3", "c", None), ("3", "c", None), ("4", "d", ""), ("4", "d", "")]


def test_repeated_rows_come_out_as_often_as_they_go_in(spark):
    df = spark.createDataFrame([("a", "ｃ⼤", 1)] * 5 + [("a", "c大", 1)] * 3, "id string, t string, `odd name` int").repartition(3)
    assert [tuple(r) for r in H.house_columns(df, {"t": "h"}).groupBy("t", "h", "odd name").count().orderBy("count").collect()] == [("c大", "c大", 1, 3), ("ｃ⼤", "c大", 1, 5)]


def test_pieces_do_not_carry_the_texts(spark):
    long = [("a" + "⼤ｃ" * 20000, "x" * 40000)]
    got = H.house_columns(spark.createDataFrame(long, "t string, other string"), {"t": "h"}).first()
    assert got["h"] == "a" + "大c" * 20000 and got["other"] == long[0][1]


def test_bare_forms(spark):
    df = spark.createDataFrame([("Ａ，B c。", "甲 / /乙_A/")], "t string, g string")
    r = df.select(H.bare(F.col("t")).alias("t"), H.bare_glosses(F.col("g")).alias("g")).first()
    assert (r["t"], r["g"]) == ("ａbc", "甲/乙a")


def test_hyphens_ligatures_small_and_vertical_marks(spark):
    cases = [
        ("甲‑乙", "甲‐乙"), ("ﬁlm", "film"), ("ﬃ", "ffi"), ("ﬆ", "st"), ("ﬁ́", "fí"), ("Ĳssel", "IJssel"), ("ǆ", "dž"),
        ("好﹐嗎﹖", "好，嗎？"), ("﹙甲﹚﹑乙﹔", "（甲）、乙；"), ("﹣﹪", "-%"), ("你好︒", "你好。"), ("︐︙︵﹁甲﹂︶", "，…（「甲」）"), ("\u2329甲\u232a", "〈甲〉"), ("甲‐乙…", "甲‐乙…"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "id int, text string")
    assert [r["house"] for r in sorted(H.house_form(df, ["id"], "text").collect())] == [want for _, want in cases]
    assert {r["id"] for r in H.disguised(df, "id", ["text"]).collect()} == {i for i, (t, want) in enumerate(cases) if t != want}


def test_every_character_with_another_form_is_looked_at(spark):
    written = {}
    for ch, piece, *_ in H._tables()[0]:
        written[ch] = written.get(ch, "") + piece
    other = [ch for ch, out in (written | H.LIGATURES).items() if unicodedata.normalize("NFC", out) != ch]
    df = spark.createDataFrame([(ch,) for ch in other], "t string")
    assert [r["t"] for r in df.filter(~H.needs_rebuild(F.col("t"))).collect()] == []
