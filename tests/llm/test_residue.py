import random

import pytest

from signloom.llm import residue as R

SENTENCES = ["因為小{a}要尋找竹編{b}，所以先到{c}閱讀{d}。", "「{b}」這個手勢通常放在動詞前面。", "長句可以拆成兩段，中間停頓約{n}秒。", "The signer places {b} before the verb and holds the sign for {n} frames.", "星期{a}他們在{c}測試{d}，然後分享{b}。", "第{n}段的「{b}」速度太快，建議放慢。"]
TALK = ["字幕組討論「伺服器發生錯誤」怎麼打，最後決定先打「電腦」再打「壞」。", "The sign for ERROR 404 was asked for by an IT class, so we recorded it.", "規則說明：範本裡的 {P} 代表地點，展開後會換成真正的地名。", "In the guide, {{ gloss }} stands for the answer and is always replaced before export."]
ERRORS = ["Internal server error\n\nPlease try again later.", "找不到您要的頁面\n請返回首頁或聯絡管理員。\n錯誤代碼：404", "Home > Clips > View\nRequest timed out\nReturn to the previous page.", "You need to enable JavaScript to run this app.", "本網頁需要啟用 JavaScript 才能正常顯示。\n首頁｜詞彙｜登入", "sample text goes here\nplaceholder paragraph", "範例文字範例文字範例文字。\n測試測試！"]
SLOTS = ["{{word}}", "${sentence}", "<%= x %>", "[[headword]]", "{P}", "%(chinese)s", "__TITLE__", "@@slot1@@", "【請填入例句】", "[INSERT CLIP HERE]", "（待填：地點）", "<<SIGNER>>", "XX年XX月XX日", "$GLOSS$", "%s"]
SCHEMA = "doc_id long, text string, kind string, model string"


def content(rng, n):
    words = ["棋盤", "圍巾", "藥水", "BREAD", "蛋糕", "圖書館", "沙丘", "三", "六", "梅"]
    return [rng.choice(SENTENCES).format(a=rng.choice(words), b=rng.choice(words), c=rng.choice(words), d=rng.choice(words), n=rng.randint(1, 900)) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(12)
    docs = [("\n".join(content(rng, rng.randint(2, 9))), False) for _ in range(700)]
    docs += [("\n".join([*content(rng, 2), rng.choice(TALK), *content(rng, 2)]), False) for _ in range(120)]
    docs += [(rng.choice(ERRORS) + (f"\nReference #{rng.randint(1, 9999)}" if rng.random() < 0.5 else ""), True) for _ in range(60)]
    docs += [("\n".join([*content(rng, 2), f"請同學在{s}集合後開始錄影。", *content(rng, 1)]), True) for s in SLOTS * 3]
    docs += [("\n".join([content(rng, 1)[0], "這裡是內文這裡是內文。", "測試測試測試！", "範例文字"]), True) for _ in range(10)]
    rng.shuffle(docs)
    return docs


def test_residue_is_told_from_talk_about_it(spark, corpus):
    df = spark.createDataFrame([(i, t, "k", "m") for i, (t, _) in enumerate(corpus)], SCHEMA)
    got = {r["doc_id"]: r["is_residue"] for r in R.judge(df, "doc_id", "text").collect()}
    missed = [t for i, (t, bad) in enumerate(corpus) if bad and not got[i]]
    wrong = [t for i, (t, bad) in enumerate(corpus) if not bad and got[i]]
    assert len(missed) <= 2, missed[:3]
    assert len(wrong) <= 2, wrong[:3]


def test_a_bounded_sample_serves_as_well(spark, corpus):
    df = spark.createDataFrame([(i, t, "k", "m") for i, (t, _) in enumerate(corpus)], SCHEMA)
    model = R.learn(df, "doc_id", "text", most=600)
    got = {r["doc_id"]: r["is_residue"] for r in R.judge(df, "doc_id", "text", model).collect()}
    right = sum(got[i] == bad for i, (_, bad) in enumerate(corpus))
    assert right >= 0.97 * len(corpus)


def test_edges(spark, rows):
    data = [(1, None, "", ""), (2, "", "", ""), (3, " \n　", "", ""), (4, "你好。", "", ""), (4, "你好。", "", ""), (None, "{{word}}常和動詞一起出現。", "", ""), (5, "好" * 20000, "", ""), (6, "12\t34\t56", "", "")]
    df = spark.createDataFrame(data, SCHEMA)
    got = rows(R.judge(df, "doc_id", "text").select("doc_id", "is_residue", "kind"))
    assert got == sorted([(1, False, None), (2, False, None), (3, False, None), (4, False, None), (4, False, None), (None, True, "placeholder"), (5, False, None), (6, False, None)], key=repr)
    assert R.judge(df.limit(0), "doc_id", "text").count() == 0


def test_passages_are_counted_in_parts_as_in_one(spark, corpus):
    texts = [t for t, _ in corpus] * 3
    whole = R.count(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counted = df.select("text").repartition(7).mapInArrow(R._count_task, "slot boolean, passage string, trusted double, n double, beside double, usual double")
    sums = counted.groupBy("slot", "passage").sum("trusted", "n", "usual").collect()
    assert {(r[0], r[1]): tuple(r)[2:] for r in sums} == {k: (v[0], v[1], v[3]) for k, v in whole.items()}


def test_rare_residue_of_no_known_wording_is_fitted_whatever_the_bound(spark):
    rng = random.Random(4)
    docs = ["\n".join(content(rng, 6)) for _ in range(1500)] + ["Internal server error\nwidget gizmo stalled"] * 4
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    model = R.np.frombuffer(R.learn(df, "doc_id", "text", most=20), "<f4").reshape(2, -1)
    assert R._scores(model[0], ["widget gizmo stalled"])[0] > 0


def test_the_model_and_not_the_word_list_decides_on_placeholders():
    rng = random.Random(9)
    docs = ["\n".join([*content(rng, 2), f"請同學在{rng.choice(SLOTS)}集合後開始錄影。", *content(rng, 1)]) for _ in range(200)]
    docs += ["\n".join([*content(rng, 2), rng.choice(TALK[2:]), *content(rng, 1)]) for _ in range(120)]
    worded = ["請同學在{{place}}集合後開始說明。", "請同學在{{place}}集合後開始錄影，說明"]  # the list takes these for explanations
    quoted = ["規則：範例裡的 {P} 是地點，展開後會變成真正的地名。"]  # and this for none
    docs += ["\n".join([*content(rng, 2), p, *content(rng, 1), *([TALK[2]] if p in quoted else [])]) for p in (worded + quoted) * 4]
    found = R.count(docs)
    model = R.fit([(slot, p, *map(float, v)) for (slot, p), v in found.items()], 8)
    said = lambda text: [s > 0 for s in R._scores(model[1], R.passages(text)[1])]
    assert [said(p) for p in worded] == [[True]] * 2 and all(R.EXPLAIN.search(p) for p in worded)
    assert said(quoted[0]) == [False] and not R.EXPLAIN.search(quoted[0])
    assert [said(p) for p in TALK[2:]] == [[False]] * 2 and said("請同學在{P}集合後開始錄影。") == [True]


def test_a_share_smaller_than_any_bucket_is_still_met(spark):
    few = spark.range(1_000_000).filter(R.chosen(R.F.xxhash64("id"), R.F.lit(40_000 / 2e9))).count()
    assert 5 <= few <= 50
    assert spark.range(1000).filter(R.chosen(R.F.xxhash64("id"), R.F.lit(1.0))).count() == 1000


def test_known_wordings_are_those_of_the_patterns(corpus):
    parts = {p for t, _ in corpus for p in R.passages(t)[0]} | {"the the end", "go-go go", "no. no", "abcabc", "甲乙甲乙。", "ſcript needed", "xyz xy z", "error 50x", "error 500", "nothing here at all"}
    assert {p for p in parts if R.is_known(p)} == {p for p in parts if R.SEED.search(R._replaced(p, R.FOLDED))}
