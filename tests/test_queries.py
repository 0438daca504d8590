import __spark_entry__ as engine


def test_label_rows_are_whole_up_to_the_limit_of_the_reference(spark, tmp_path):
    rows = [(0, "問" * 60, "答/案"), (1, "問" * 500, "答" * 40), (2, "問" * 512, "答"), (3, "問", ""), (4, None, "答")]
    spark.createDataFrame(rows, "_ord long, chinese string, ref string").write.parquet(str(tmp_path / "finetuned_e4b_ep2_test.parquet"))
    got = {r["_ord"]: r["labels"] for r in engine.queries()["mask_labels_512"](spark, str(tmp_path)).collect()}
    assert got == {0: [-100] * 60 + [ord(c) for c in "答/案"], 1: [-100] * 500 + [ord("答")] * 12, 2: [-100] * 512}
