import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from signloom.operators import checks, joins, metrics, order, vocabulary
from signloom.plans import corpus


# ---- metrics


def bleu(pairs):
    top, low = [0] * 4, [0] * 4
    for ref, hyp in pairs:
        for n in range(4):
            a, b = (Counter(tuple(x[i : i + n + 1]) for i in range(len(x) - n)) for x in (ref, hyp))
            top[n] += sum((a & b).values())
            low[n] += sum(b.values())
    top, low = ([v + (n > 0) for n, v in enumerate(x)] for x in (top, low))
    r, h = (sum(len(p[i]) for p in pairs) for i in (0, 1))
    if not h or min(top + low) == 0:
        return 0.0
    return 100 * (1 if h > r else math.exp(1 - r / h)) * math.exp(sum(math.log(a / b) for a, b in zip(top, low)) / 4)


@pytest.mark.parametrize("longest", [3, 12])
def test_bleu_and_its_friends(spark, longest):
    rng = random.Random(longest)
    some = lambda: [rng.choice("甲乙丙丁戊") for _ in range(rng.randint(0, longest))]
    pairs = [(some(), some()) for _ in range(80)] + [(p, p) for p in (some() for _ in range(40))]
    df = spark.createDataFrame([("/".join(a), "/".join(b), "clash") for a, b in pairs], "r string, h string, ref string")
    paired = metrics.pairs(df, "r", "h")
    assert metrics.bleu(paired).first()[0] == pytest.approx(bleu(pairs))
    assert metrics.exact_match(paired).first()[0] == pytest.approx(100 * sum(a == b for a, b in pairs) / len(pairs))
    names = spark.createDataFrame([("甲",), ("乙",), ("甲",)], "n string")
    one = metrics.in_vocab(paired, names, "n").first()
    assert (one["known"], one["total"]) == (sum(t in "甲乙" for _, h in pairs for t in h), sum(len(h) for _, h in pairs))
    got = {r["metric"]: r["value"] for r in metrics.evaluate(df, "r", "h", names, "n").collect()}
    assert got["n"] == len(pairs) and got["BLEU-4"] == round(bleu(pairs), 2)


def test_bleu_without_longer_ngrams_and_of_nothing(spark):
    df = spark.createDataFrame([("甲", "甲"), ("乙/丙", "乙/丙")], "r string, h string")
    assert [tuple(r) for r in metrics.bleu_counts(metrics.pairs(df, "r", "h")).orderBy("n").collect()] == [(1, 3, 3), (2, 1, 1), (3, 0, 0), (4, 0, 0)]
    assert metrics.bleu(metrics.pairs(df, "r", "h")).first()[0] == pytest.approx(100)
    empty = spark.createDataFrame([("甲", None), (None, "")], "r string, h string")
    for some in (empty, empty.limit(0)):
        paired = metrics.pairs(some, "r", "h")
        assert metrics.bleu(paired).first()[0] == 0 and metrics.rouge_l(paired).first()[0] == 0
        assert metrics.bleu_counts(paired).count() == 4
        assert metrics.evaluate(some, "r", "h", empty, "r").count() == 5


def test_marker_positions(spark, rows):
    df = spark.createDataFrame([(["要", "a", "b"],), (["a", "不要"],), (["a", "要", "b"],), (["要"],), (["a", "b"],), (None,)], "g array<string>")
    assert rows(metrics.marker_positions(df, "g", {"m": ["要"], "none": ["x"]})) == [("m", 3, 1, 1, 1)]


# ---- order


def test_running_values_equal_one_window(spark):
    rng = random.Random(3)
    data = [(n, rng.choice("ab"), rng.randint(0, 9) if n % 5 else None) for n in rng.sample(range(300_000), 400)]
    df = spark.createDataFrame([(*d, 1) for d in data], "_ord long, k string, v int, __n int").repartition(3)
    got = {r["_ord"]: r["s"] for r in order.running_sum(df, F.col("v"), "_ord", "s", by=["k"]).collect()}
    sums, want = defaultdict(int), {}
    for n, k, v in sorted(data):
        sums[k] += v or 0
        want[n] = sums[k]
    assert got == want
    ids = {r["_ord"]: r["id"] for r in order.sequential_ids(df, "_ord", "id", "X", 4).collect()}
    assert [ids[n] for n in sorted(ids)] == [f"X{i:04}" for i in range(1, 401)]


def test_blocks_drop_what_comes_before_the_first(spark, rows):
    df = spark.createDataFrame([(1, None), (2, "f"), (3, None), (4, "g"), (5, None)], "_ord long, file string")
    assert rows(order.blocks(df, F.col("file").isNotNull(), "_ord").select("_ord", "block")) == [(2, 1), (3, 1), (4, 2), (5, 2)]
    assert order.blocks(df.limit(1), F.col("file").isNotNull(), "_ord").count() == 0


def test_keep_first_and_last(spark, rows):
    df = spark.createDataFrame([(3, "a", None), (1, "a", "x"), (2, None, "y"), (4, None, "z")], "_ord long, k string, v string")
    assert rows(order.keep_first(df, ["k"], "_ord")) == [(1, "a", "x"), (2, None, "y")]
    assert rows(order.keep_first(df, ["k"], "_ord", last=True)) == [(3, "a", None), (4, None, "z")]


def test_holdout_takes_whole_groups_until_the_target(spark):
    rng = random.Random(1)
    data = [(n, f"g{int(rng.paretovariate(0.9)) % 60}", rng.choice("st")) for n in range(900)] + [(n, "tiny", "u") for n in range(1000, 1009)] + [(n, None, "s") for n in range(2000, 2040)]
    df = spark.createDataFrame(data, "_ord long, grp string, src string")
    held = order.greedy_holdout(df, "grp", 0.1, 42, "src", 10).collect()
    sizes = Counter((s, g) for _, g, s in data)
    assert all(sizes[r["stratum"], r["group"]] == r["size"] for r in held)
    for s in "stu":
        n = sum(v for (x, _), v in sizes.items() if x == s)
        own = [r["size"] for r in held if r["stratum"] == s]
        target = round(n * 0.1) if n >= 10 else 0
        assert sum(own) >= target and (not own or sum(own) - max(own) < target + max(own))
        assert target or not own
    assert order.greedy_holdout(df, "grp", 0.0, 42).count() == 0
    again = order.greedy_holdout(df.repartition(7), "grp", 0.1, 42, "src", 10).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, held), key=repr)


def test_samples_and_heads(spark):
    df = spark.createDataFrame([(n, str(n)) for n in range(50)], "_ord long, id string")
    assert order.hashed_sample(df, 5, 1, "id").collect() == order.hashed_sample(df.repartition(5), 5, 1, "id").collect()
    assert [r["_ord"] for r in order.head(df, "_ord", 3).collect()] == [0, 1, 2]


# ---- joins


def test_anti_joins(spark, rows):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, None, "z"), (4, "c", None), (5, "d", "w")], "i int, a string, b string")
    other = spark.createDataFrame([("a", "q"), ("q", "y"), (None, None), ("a", "q")], "a string, b string")
    assert rows(joins.not_in_any(df, other, ["a", "b"]).select("i")) == [(3,), (4,), (5,)]
    assert rows(joins.resume(df, other, "a").select("i")) == [(2,), (3,), (4,), (5,)]
    plan = joins.not_in_any(df, other, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a", "rule", "wide")], "_ord long, id string, confidence string, other string").write.parquet(path)
    df = spark.read.parquet(path).filter("confidence = 'rule'")
    for made in (order.keep_first(df.select("_ord", "id"), ["id"], "_ord"), joins.not_in_any(df.select("_ord", "id"), df.limit(0), ["id"])):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(confidence,rule)" in plan and "other" not in plan and "Window" not in plan


def test_update_expand_and_membership(spark, rows):
    df = spark.createDataFrame([(1, "old", "k"), (2, "old", "k"), (3, None, "k")], "id int, v string, __v string")
    news = spark.createDataFrame([(1, "new"), (2, None), (9, "x")], "id int, v string")
    assert rows(joins.updated(df.drop("__v"), news, "id", ["v"])) == [(1, "new"), (2, "old"), (3, None)]
    lists = spark.createDataFrame([(1, ["a", "b"], None)], "id int, x array<string>, y array<string>")
    assert rows(joins.expanded(lists, p="x", q="y").select("p_at", "p", "q")) == [(0, "a", None), (1, "b", None)]
    a, b = (spark.createDataFrame([(k,) for k in ks], "k string") for ks in (["x", "y", "y"], ["y", "z"]))
    assert rows(joins.flagged_membership([("a", a), ("b", b)], "k")) == [("x", True, False), ("y", True, True), ("z", False, True)]
    assert rows(joins.shared_groups(a, b, "k")) == [("y",)]


def test_unexpected_tokens_and_first_keyword(spark, rows):
    df = spark.createDataFrame([(1, ["a", "q", "q"], "車站的電腦"), (2, None, None), (3, [], "無")], "id int, g array<string>, t string")
    names = spark.createDataFrame([("a",), ("a",)], "n string")
    assert rows(joins.unexpected_tokens(df, "id", "g", names, "n")) == [(1, 1, "q"), (1, 2, "q")]
    words = spark.createDataFrame([(2, "object", "電腦"), (1, "place", "車站")], "ord int, theme string, keyword string")
    assert rows(joins.first_keyword(df, "t", words).select("id", "hit_theme", "keyword")) == [(1, "place", "車站")]


# ---- vocabulary


def test_master_and_coverage(spark):
    own = spark.createDataFrame([("甲",), ("甲",), ("乙",)], "gloss string")
    entries = spark.createDataFrame([("台", ["檯", "甲"], [2, 1]), ("丙", None, None)], "surface string, aliases array<string>, ids array<bigint>")
    corpus = spark.createDataFrame([("臺", 5), ("甲", 2), ("丁", 3)], "gloss string, freq long")
    listed = vocabulary.master(own, entries, corpus)
    got = {r["surface"]: (r["sources"], r["corpus_freq"], r["has_dict_entry"], r["norm_has_dict_entry"], r["twtsl_ids"]) for r in listed.collect()}
    assert got == {
        "甲": (["own", "twtsl-alias", "corpus"], 2, True, True, []), "乙": (["own"], 0, True, True, []), "台": (["twtsl"], 0, True, True, [1, 2]), "檯": (["twtsl-alias"], 0, True, True, []),
        "丙": (["twtsl"], 0, True, True, []), "臺": (["corpus"], 5, False, True, []), "丁": (["corpus"], 3, False, False, []),
    }
    one = vocabulary.coverage(listed).first()
    assert (one["corpus_unique_gloss"], one["corpus_token_total"], one["corpus_type_in_dict_raw"], one["corpus_type_in_dict_norm"], one["corpus_token_in_dict_norm"]) == (3, 10, 1, 2, 7)
    assert (one["corpus_type_in_dict_norm_pct"], one["corpus_token_in_dict_norm_pct"]) == (66.7, 70.0)
    assert vocabulary.coverage(listed.limit(0)).first()["corpus_token_in_dict_norm_pct"] == 0.0


def test_postings_aliases_and_flags(spark, rows):
    df = spark.createDataFrame([("s1", ["甲", "甲", "＿x", None], 1), ("s2", ["甲"], 2), ("s3", None, 3)], "id string, g array<string>, o long")
    assert rows(vocabulary.postings(df, "id", "g", "o")) == [("甲", "s1", 1), ("甲", "s2", 2)]
    entries = spark.createDataFrame([(1, "台階", ["臺階", "梯_A", "梯", "坡"]), (2, "x", None)], "k int, s string, a array<string>")
    assert rows(vocabulary.alias_names(entries, "k", "s", "a")) == [(1, ["坡", "梯"]), (2, [])]
    flags = spark.createDataFrame([(["a", "b"],), (["a"],), ([],), (None,)], "f array<string>")
    assert rows(vocabulary.flag_rollup(flags, "f")) == [("a", 2), ("b", 1), ("none", 2)]
    named = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "b", 3)], "k int, n string, o int")
    assert rows(vocabulary.ordered_names(named, "k", "n", "o")) == [(1, ["b", "a"])]


# ---- checks


def test_checks(spark):
    df = spark.createDataFrame([(1,)], "a int")
    checks.expect_rows(df, 1, "one")
    checks.expect_columns(df, ["a"], "sheet")
    checks.expect_none(df.limit(0), "none")
    for f in (lambda: checks.expect_rows(df, 2, "two"), lambda: checks.expect_columns(df, ["b"], "sheet"), lambda: checks.expect_none(df, "some")):
        with pytest.raises(checks.CheckFailed):
            f()


def test_verdicts(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string").coalesce(1)
    got = df.select(checks.verdict([(F.col("b") == "x", "yes")], "no").alias("v"), checks.notes([(F.col("a") > 0, "p"), (F.col("b").isNull(), "q")], "s").alias("n")).collect()
    assert [tuple(r) for r in got] == [("no", "s；p；q"), ("yes", "s；p")]
    said = spark.createDataFrame([("甲要確認；native",), ("甲要確認；",), ("可；要確認",)], "t string").coalesce(1)
    assert [r[0] for r in said.select(checks.bucket(F.col("t"), [("native", "n")], [("確認", "c")], "ok")).collect()] == ["n", "c", "ok"]


def test_blocks_from_token_rows(spark, rows):
    data = [(1, 7, 2, "乙", "s"), (1, 7, 1, "甲", "s"), (2, 7, 1, None, "s"), (3, 8, 1, "丙", "t"), (3, 8, 1, "丁", "t")]
    df = spark.createDataFrame(data, "o long, block long, place int, token string, sid string")
    got = rows(corpus.block_tokens(df, "block", "place", "o", "token", "sid"))
    assert got == [(7, ["甲", "乙"], 1, "s"), (8, ["丁", "丙"], 3, "t")]
    assert corpus.block_tokens(df.limit(0), "block", "place", "o", "token", "sid").count() == 0


def test_nested_records(spark, rows):
    df = spark.createDataFrame([("a", [("x", ["p", None])]), ("b", []), ("c", None), ("d", [None]), ("e", [("y", None)])], "id string, recs array<struct<n:string,l:array<string>>>")
    assert rows(joins.first_record(df, "recs", "r").select("id", "r.n")) == [("a", "x"), ("d", None), ("e", "y")]
    first = joins.first_record(df, "recs", "r")
    assert rows(joins.nested_rows(first, "r.l", "t", "at").select("id", "at", "t")) == [("a", 0, "p"), ("a", 1, None)]


def test_union_in_order_and_alias_lists(spark, rows):
    a, b = spark.createDataFrame([(2, "x")], "_ord long, id string"), spark.createDataFrame([("y", 1), ("z", None)], "id string, _ord long")
    assert rows(joins.in_order([a, b], "_ord")) == [(0, 2, "x"), (1, 1, "y"), (1, None, "z")]
    entries = spark.createDataFrame([(1, "飯_A"), (2, "水"), (3, None)], "id long, name string")
    names = spark.createDataFrame([(1, "飯"), (1, "吃_B2 "), (1, "吃"), (1, None), (9, "無"), (2, "水")], "id long, alias string")
    assert rows(vocabulary.alias_lists(entries, "id", "name", names, "alias")) == [(1, "飯_A", ["吃"]), (2, "水", []), (3, None, [])]


def test_drops_are_counted_before_dedup(spark, rows):
    pool = spark.createDataFrame([("a", "x", "s"), ("a", "x", "s"), ("b", "y", "s"), (None, "y", None), ("c", None, None)], "t string, g string, src string")
    test = spark.createDataFrame([("a", "q"), (None, "y"), (None, None)], "t string, g string")
    assert rows(joins.drop_counts(pool, test, ["t", "g"], "src")) == sorted([("s", 3, 3, 0), (None, 2, 1, 1)], key=repr)
    assert rows(joins.not_in_any(pool, test, ["t", "g"]).select("t", "g", "src")) == [("c", None, None)]


def test_rows_that_hold_no_other_text(spark, rows):
    texts = ["今天我去圖書館看書", "我去", "去圖", "", None, "我去圖書館", "很長" * 3000 + "我去圖書館"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for others in (["我去圖書館"], ["書"], ["去圖", "看書看書看書"], ["", None], ["今天我去圖書館看書了"], ["很長" * 2999 + "很長我"]):
        small = spark.createDataFrame([(o,) for o in others], "o string")
        want = [i for i, t in enumerate(texts) if not (t and any(o and o in t for o in others))]
        assert [r["id"] for r in joins.not_containing(df, "t", "id", small, "o").orderBy("id").collect()] == want


def test_runs_of_texts_are_not_broadcast(spark, tmp_path):
    # Spark takes the runs to be as large as the file, however many times that they are
    texts = [f"{i * 7919 % 100_003:06d}今天我去圖書館看書{i:05d}" for i in range(5000)]
    spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1).write.parquet(str(tmp_path / "t"))
    spark.createDataFrame([(t[3:],) for t in texts[::5]], "o string").coalesce(1).write.parquet(str(tmp_path / "o"))
    got = joins.not_containing(spark.read.parquet(str(tmp_path / "t")), "t", "id", spark.read.parquet(str(tmp_path / "o")), "o")
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.columns == ["id", "t"] and [r["id"] for r in got.orderBy("id").collect()] == [i for i in range(5000) if i % 5]


def test_texts_decide_what_holds_another_whatever_their_keys(spark, rows):
    df = spark.createDataFrame([("a", "我去圖書館"), ("a", "我去車站"), (None, "我去圖書館"), (None, "我去車站"), (None, None), ("a", "我去車站")], "id string, t string")
    others = spark.createDataFrame([("圖書館",), ("圖書館",), ("圖書館很大",)], "o string")
    assert rows(joins.not_containing(df, "t", "id", others, "o")) == sorted([("a", "我去車站"), ("a", "我去車站"), (None, "我去車站"), (None, None)], key=repr)


def test_a_null_group_is_held_out_whole(spark):
    pool = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "group string, n int")
    held = spark.createDataFrame([(None,)], "group string")
    assert [r["n"] for r in joins.in_groups(pool, held, "group", "left_anti").collect()] == [1]
    assert sorted(r["n"] for r in joins.in_groups(pool, held, "group", "left_semi").collect()) == [2, 3]


def test_metrics_of_one_pass_match_plain_counts(spark):
    rng = random.Random(8)
    pairs = [("/".join(rng.choice("甲乙丙丁戊") for _ in range(rng.randint(0, 90))), "/".join(rng.choice("甲乙丙丁") for _ in range(rng.randint(0, 80)))) for _ in range(60)] + [("甲/乙", "甲/乙"), (None, "甲"), ("甲", None), ("", "")]
    own = [([t for t in (a or "").split("/") if t], [t for t in (b or "").split("/") if t]) for a, b in pairs]

    def lcs(a, b):
        line = [0] * (len(b) + 1)
        for x in a:
            line = [0, *(line[:1] and [0] * len(b))] if not b else _next(line, x, b)
        return line[-1]

    def _next(line, x, b):
        out = [0]
        for j, y in enumerate(b):
            out.append(line[j] + 1 if x == y else max(line[j + 1], out[j]))
        return out

    grams = lambda t, n: Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
    got = metrics.sums(metrics.pairs(spark.createDataFrame(pairs, "ref string, pred string").repartition(3), "ref", "pred")).first()
    for n in (1, 2, 3, 4):
        assert got[f"matches_{n}"] == sum((grams(a, n) & grams(b, n)).total() for a, b in own)
        assert got[f"total_{n}"] == sum(max(len(b) - n + 1, 0) for _, b in own)
    assert got["n"] == len(pairs) and got["exact"] == sum(a == b for a, b in own)
    assert abs(got["f1"] - sum(2 * lcs(a, b) / (len(a) + len(b)) for a, b in own if a and b)) < 1e-9
