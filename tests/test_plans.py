import json

import pytest
from pyspark.sql import functions as F

from signloom.plans import corpus, durable, prompts, split
from signloom.sources import readers, sinks
from signloom.streaming import resume

RECORD = "_ord long, id string, chinese string, gloss_text string, source string, group string, confidence string, review_status string"


def test_split_leaks_nothing(spark):
    rows = [(n, f"c{n}", f"句{n % 90}", f"甲/乙{n % 90}", "tslcorpus", f"corpus:{n % 17}", None, None) for n in range(200)]
    rows += [(500 + n, f"s{n}", f"合{n}", f"丙/丁{n}", "synth", f"synth:{n % 11}", "rule-derived" if n % 3 == 0 else None, "ok") for n in range(120)]
    rows += [(900, "x1", "考題", "別的/詞", "synth", "synth:x", None, None), (901, "x2", "別的", "考/題", "synth", "synth:x", None, None), (902, "x3", "單", "單", "tslcorpus", "corpus:z", None, None), (903, "x4", "", "空/的", "synth", "synth:x", None, None), (904, "x5", "空格", "＿/的", "synth", "synth:x", None, None)]
    test = spark.createDataFrame([(0, "t", "考題", "考/題", "core", "test:t", None, "n/a")], RECORD)
    placed = split.split(spark.createDataFrame(rows, RECORD), test).cache()
    got = placed.collect()
    assert all(r["shared"] == 0 for r in split.leaks(placed).collect())
    assert {r["split"] for r in got} == {"train", "dev", "test_corpus", "test"}
    assert not {"x1", "x2", "x3", "x4", "x5"} & {r["id"] for r in got}
    assert len({(r["chinese"], r["gloss_text"]) for r in got}) == len(got)
    assert not [r for r in got if r["confidence"] == "rule-derived"]
    held = {r["chinese"] for r in got if r["split"] == "test_corpus"}
    assert not held & {r["chinese"] for r in got if r["split"] in ("train", "dev")}
    counts = {(r["split"], r["source"]): r["rows"] for r in split.manifest(placed).collect()}
    assert sum(counts.values()) == len(got)
    assert split.split(placed.limit(0).drop("split"), test).count() == 1


def test_consolidate_and_blocks(spark, rows):
    data = [(3, "9/1", "晚", ["晚"], "/f"), (1, "9/1", "早", ["早，", "。"], "/f"), (2, "9/2", "", ["x"], None), (4, "9/3", "空", ["。"], "g"), (5, "9/4", "好", ["好++", None], "g"), (6, "9/5", None, None, None)]
    df = spark.createDataFrame(data, "_ord long, corpus_id string, chinese string, gloss array<string>, film_url string")
    assert rows(corpus.consolidate(df, "http://h")) == [("TC000000001", "9/1", "早", "早", "http://h/f"), ("TC000000002", "9/4", "好", "好++", "g")]
    marked = spark.createDataFrame([(1, 1, "s", "t1", "g", ["b"]), (2, 2, "s", "t2", "g", ["a", "b"]), (3, 2, "r", "t", "g1", []), (4, 3, "r", "t", "g2", [])], "o long, block long, sid string, t string, g string, m array<string>")
    assert rows(corpus.merge_blocks(marked, "block", "sid", "o", "t", "g", "m")) == [("r", "t", "g1", 2, []), ("s", "t1", "g", 2, ["a", "b"])]
    assert rows(corpus.inconsistent(marked, "sid", "g")) == [("r", 2)]


def test_templates_and_increments(spark, rows):
    templates = spark.createDataFrame([(1, "T1", ["{P}好", "{P}很好"], ["{T}", "{P}", "好"], ["甲", "乙"], None), (2, "T2", ["甲好"], ["甲", "好"], None, None)], "ord int, tid string, phrasings array<string>, gloss array<string>, slots array<string>, times array<string>")
    real = spark.createDataFrame([("乙好",), (None,)], "chinese string")
    made = corpus.expand_templates(templates, real)
    assert rows(made.select("tid", "chinese", "gloss_text")) == [("T1", "乙很好", "乙/好"), ("T1", "甲好", "甲/好"), ("T1", "甲很好", "甲/好")]
    old = spark.createDataFrame([("SYN0007", "甲好", "甲/好", "1")], "id string, chinese string, gloss_text string, batch string")
    merged = corpus.merge_synthetic(old, made, "2")
    assert rows(merged) == [("SYN0007", "甲好", "甲/好", "1"), ("SYN0008", "甲很好", "甲/好", "2"), ("SYN0009", "乙很好", "乙/好", "2")]
    assert rows(corpus.merge_synthetic(merged, made, "3")) == rows(merged)


def test_prompts_and_inference(spark, rows):
    df = spark.createDataFrame([("1", "你好", "你/好"), ("2", None, None)], "id string, t string, g string")
    made = [r[0] for r in df.coalesce(1).select(prompts.prompt("做", F.col("t"), "規則", prompts.exemplars([("1", "a", "b"), ("9", "c", "d")], F.col("id")))).collect()]
    assert made[0] == "做\n\n規則\n\n中文：c\nGloss：d\n\n中文：你好\nGloss："
    chat = [r[0] for r in df.coalesce(1).select(prompts.messages(F.col("t"), F.col("g"))).collect()]
    assert [len(c) for c in chat] == [2, 1]
    assert rows(prompts.infer(df, "id", "t", lambda: lambda texts: [x.upper() + "!" for x in texts])) == [("1", "你好!"), ("2", "!")]
    assert rows(prompts.encode(df, "id", "t", lambda: lambda texts: [[len(x)] for x in texts])) == [("1", [2]), ("2", [0])]


def test_sources(spark, rows, tmp_path):
    good, log, whole = tmp_path / "good.jsonl", tmp_path / "log.jsonl", tmp_path / "whole.json"
    good.write_text('{"id": "1"}\n\n{"id": "2"}\n')
    log.write_text('{"id": "1"}\n{"id": "2\n{"x": 1}\n')
    whole.write_text('{"glosses": {"甲": ["a"],\n "乙": []}}')
    schema = spark.createDataFrame([], "id string").schema
    assert rows(readers.json_lines(spark, str(good), schema)) == [("1",), ("2",)]
    assert rows(readers.json_log(spark, str(log), schema, "id")) == [("1",)]
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        readers.json_lines(spark, str(log), schema).collect()
    assert [r[0] for r in rows(readers.json_object_keys(spark, str(whole), "glosses"))] == ["乙", "甲"]
    assert readers.optional(spark, str(tmp_path / "none.jsonl"), schema).count() == 0
    assert readers.optional(spark, str(good), schema).count() == 2
    readers.register(spark)
    pages, broken = tmp_path / "pages.jsonl", str(tmp_path / "nowhere.jsonl")
    pages.write_text("".join(f'{{"id": {n}}}\n' for n in range(5)))
    paged = lambda *starts, **o: spark.read.format("paged").options(starts=json.dumps(starts), pagesize="2", pause="0", tries="1", **o).load()
    assert rows(paged(str(pages)).select("page", "record"))[2] == (2, '{"id": 2}')
    assert paged(str(pages), broken, onfailure="skip").count() == 5
    with pytest.raises(Exception, match="No such file"):
        paged(broken).collect()


def test_sheets(spark, tmp_path):
    (tmp_path / "a.csv").write_text("_ord,id\n1,x\n")
    (tmp_path / "~$a.csv").write_text("_ord,id\n9,lock\n")
    assert readers.without_locks(spark, str(tmp_path), "_ord long, id string").count() == 1
    assert readers.landed_sheet(spark, str(tmp_path / "a.csv"), ["id"]).count() == 1
    assert readers.landed_sheet(spark, str(tmp_path / "a.csv"), ["verdict"]).count() == 0


def test_sinks(spark, rows, tmp_path):
    df = spark.createDataFrame([(2, "é", None), (1, None, "x")], "o int, a string, b string")
    sinks.write_json_lines(df, str(tmp_path / "out"), "o")
    lines = [x for p in sorted((tmp_path / "out").glob("*.json")) for x in p.read_text().splitlines()]
    assert lines == ['{"o":1,"a":null,"b":"x"}', '{"o":2,"a":"é","b":null}']
    sinks.append_log(df, str(tmp_path / "log"))
    sinks.append_log(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    old, new = (spark.createDataFrame(x, "k string, v int") for x in ([("a", 1), ("b", 2)], [("b", 3), ("c", 4)]))
    assert rows(sinks.upsert(old, new, ["k"])) == [("a", 1), ("b", 3), ("c", 4)]
    assert json.loads(sinks.object_json(old, "k", "v").first()[0]) == {"a": 1, "b": 2}
    assert sinks.review_sheet(old, ["k"], ["note"]).columns == ["k", "note"]


def test_resumed_stream(spark, tmp_path):
    landing, log = tmp_path / "in", str(tmp_path / "log")
    landing.mkdir()
    schema = spark.createDataFrame([], "id string, x int").schema
    run = lambda: resume.run_available(spark, str(landing), schema, log, str(tmp_path / "cp"), lambda d: d.filter("x > 0")).awaitTermination(120)
    (landing / "1.json").write_text('{"id": "a", "x": 1}\n{"id": "b", "x": 0}\n')
    run()
    (landing / "2.json").write_text('{"id": "c", "x": 2}\n')
    run()
    run()
    assert sorted(r["id"] for r in spark.read.parquet(log).collect()) == ["a", "c"]
    assert resume.replay(spark, log, lambda d: d.select(F.count(F.lit(1)))).first()[0] == 2
    batch = spark.createDataFrame([("a", 1), ("d", 1), ("d", 1)], schema)
    resume.append_new(batch, spark.read.parquet(log), str(tmp_path / "log2"), "id")
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "log2")).collect()] == ["d"]


class _Cluster:
    """A session as far as ``shared_folder`` looks at it."""

    class conf:
        get = staticmethod(lambda name, default: default)

    def __init__(self, master):
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-1"})


def test_no_private_folder_on_a_cluster(spark):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        durable.shared_folder(_Cluster("spark://host:7077"))
    assert durable.shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    kept = durable.cut(spark.range(5))
    durable.sweep(spark)
    assert kept.count() == 5


def test_landed_sheets_with_names_in_a_row_or_none(spark, rows, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('1,title,,\n2,note,"two\nlines",\n3,id,text,\n4,a,x,1\n5,b,,\n')
    assert rows(readers.sheet_from_row(spark, str(path), ["id", "text"], 4)) == [(4, "a", "x"), (5, "b", None)]
    named = readers.sheet_with_header_row(spark, str(path), 3, 3)
    assert named.columns == ["_ord", "id", "text"] and rows(named) == [(4, "a", "x"), (5, "b", None)]
    lines = tmp_path / "l.jsonl"
    lines.write_text('{"id": "1"}\n\n{"id": "2"}\n')
    with pytest.raises(Exception, match="a blank line"):
        readers.json_lines_unbroken(spark, str(lines), "id string").collect()
    lines.write_text('{"id": "1"}\n{"id": "2"}\n')
    assert rows(readers.json_lines_unbroken(spark, str(lines), "id string")) == [("1",), ("2",)]
    sinks.append_log(spark.range(10).coalesce(1), str(tmp_path / "log"), every=4)
    assert len(list((tmp_path / "log").glob("*.parquet"))) == 3 and spark.read.parquet(str(tmp_path / "log")).count() == 10
