import pytest

from signloom.llm import answers as A

NAMES = ["我", "昨天", "圖書館", "圖書", "書", "借", "要", "抱歉", "不能", "Brigaizax", "Vemestuln", "沙丘溪口", "沒有"]
PROMPT = "我昨天在圖書館借了三本書，還要借兩本。"
CASES = [
    ("", "empty"), (None, "empty"), (" 　\n", "empty"), ("Gloss：", "empty"), ("手語：「」", "empty"), ("```\n```", "empty"), ("。", "empty"),
    (PROMPT, "copy"), (f"Gloss：{PROMPT}", "copy"), (f"「{PROMPT}」", "copy"), (f"{PROMPT}\n{PROMPT}", "copy"), ("我昨天在圖書館借了三本書 還要借兩本", "copy"), (f"請將以下句子轉成手語詞序：{PROMPT}", "copy"),
    ("抱歉，我無法將這句話轉成手語詞序。", "refusal"), ("Sorry, I can't help with that sentence.", "refusal"), ("關於「我昨天在」這句，as a text model I do not know sign language", "refusal"), ("申し訳ありませんが、お答えできません", "refusal"),
    ("Book/School/Want/Go", "other_language"), ("go-umbrella-buy", "other_language"), ("qù mǎi chēzhàn", "other_language"), ("책을 사요", "other_language"), ("ほんを/かいます", "other_language"), ("Gloss：tôi tìm đến ga", "other_language"),
    ("昨天/圖書館/", "truncated"), ("昨天/圖書館／", "truncated"), ("昨天/圖書館（其中", "truncated"), ('Gloss：昨天/"要', "truncated"), ("昨天/「要", "truncated"), ("昨天/沙丘溪", "truncated"), ("先看時間詞，所以", "truncated"), ("分析：主語是「我，再把", "truncated"),
    ("昨天/圖書館/我/書/借/要", None), ("要", None), ("抱歉 / 昨天 / 我 / 不能 / 借。", None), ("Brigaizax/Vemestuln", None), ("昨天/圖書館（規則2）", None), ("先放時間再放地點。\n昨天/圖書館/借", None), ("`昨天/圖書館`", None), ("「昨天/圖書館」", None), ("書/昨天", None), ("沒有", None),
]


@pytest.fixture(scope="module")
def master(spark):
    return spark.createDataFrame([(n, []) for n in NAMES], "surface string, aliases array<string>")


SCHEMA = "id string, chinese string, ref string, raw string, defect string, tail string"


def test_types(spark, master):
    rows = [(f"{i:02}", PROMPT, "昨天/沙丘溪口/我/書/借/要", raw, "x", "y") for i, (raw, _) in enumerate(CASES)]
    found = A.defects(spark.createDataFrame(rows + rows[:3], SCHEMA), "id", "chinese", "ref", "raw", master).collect()
    got = {r["id"]: r["defect"] for r in found}
    assert len(found) == len(got)
    wrong = [(raw, want, got.get(f"{i:02}")) for i, (raw, want) in enumerate(CASES) if got.get(f"{i:02}") != want]
    assert not wrong


def test_nulls_long_and_none(spark, master, rows):
    data = [("a", None, None, "昨天/圖書館", "", ""), ("b", None, None, None, "", ""), (None, None, None, "", "", ""), ("c", "好" * 9000, None, "好" * 9000, "", ""), ("d", PROMPT, None, "昨天/" * 5000 + "要", "", "")]
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(A.defects(df, "id", "chinese", "ref", "raw", master)) == [("b", "empty"), ("c", "copy"), (None, "empty")]
    assert A.defects(df.limit(0), "id", "chinese", "ref", "raw", master).count() == 0
    assert A.defects(df.filter("id = 'b'"), "id", "chinese", "ref", "raw", master.limit(0)).count() == 1


def test_a_prompt_is_a_good_dictionary_for_its_copy():
    other = "星期六傍晚他們去沙丘溪口觀察烏龜和石頭，然後回家。"
    assert A.compressed_share(PROMPT, PROMPT) < 0.35 < 0.8 < A.compressed_share(other, PROMPT)


def test_what_was_kept_of_a_sound_answer_is_judged_too(spark, master, rows):
    sound = "昨天/圖書館/借"
    data = [("a", sound, sound), ("b", sound, ""), ("c", sound, None), ("d", sound, "昨天/圖書館/"), ("e", sound, "昨天/沙丘溪"), ("f", sound, PROMPT), ("g", sound, "昨天/借"), ("h", "昨天/圖書館/", ""), ("i", f"Gloss：{sound}。", sound), ("j", "昨天/沙丘溪", "")]
    df = spark.createDataFrame([(i, PROMPT, "昨天/沙丘溪口/我", raw, pred) for i, raw, pred in data], "id string, chinese string, ref string, raw string, pred string")
    got = rows(A.defects(df, "id", "chinese", "ref", "raw", master, pred="pred"))
    assert got == [("b", "empty"), ("c", "empty"), ("d", "truncated"), ("e", "truncated"), ("f", "copy"), ("h", "truncated"), ("j", "truncated")]


NEAR = [
    ("我昨天在圖書館借了四本書，還要借兩本。", True), ("我昨日在圖書館借了三本書還要借兩本", True), ("中文：我昨天在圖書館借了三本書，還要借五本。", True), (f"{PROMPT} {PROMPT.replace('三', '四')}", True),
    ("我昨天在圖書館", False), ("昨天 圖書館 我 書 借 要", False), ("三本書還要借兩本", False), ("星期六傍晚他們去沙丘溪口觀察烏龜和石頭", False),
]


def test_compression_decides_what_is_a_copy(monkeypatch):
    assert [A.is_copy(a, PROMPT) for a, _ in NEAR] == [c for _, c in NEAR]
    assert A.is_copy("好嗎", "好嗎？") and A.is_copy("「沒有」", "沒有。") and not A.is_copy("有", "好") and not A.is_copy("好", "")
    monkeypatch.setattr(A, "compressed_share", lambda *a: 1.0)
    assert not any(A.is_copy(a, PROMPT) for a in (PROMPT, *(a for a, _ in NEAR)))
