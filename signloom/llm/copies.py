"""Records that differ in formatting only are collapsed, and their copies counted.

The canonical bytes of the records are partitioned recursively by radix: buckets of one prefix that
hold too many rows or bytes are split by further bytes until each fits. Every bucket is then read into a trie
of canonical bytes with a counter and the keys at each terminal. A bucket that no byte can split (all
its rows are copies of one text) is salted by key; its tries are combined by one more, small,
aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signloom.llm.house_form import bare, bare_glosses, house_columns
from signloom.plans.durable import cut

BUCKET_ROWS, BUCKET_BYTES = 100_000, 32 << 20
STEP_BYTES = 6
STRIDE = 16


def canonical_pairs(df: DataFrame, key: str, text: str, glosses: str) -> DataFrame:
    """Rows ``key, canon`` of the records whose two texts are neither null nor empty."""
    own = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(glosses).alias("glosses")).filter("text <> '' and glosses <> ''")
    house = house_columns(own, {"text": "text_house", "glosses": "glosses_house"})
    return house.select("key", F.concat_ws("\n", bare(F.col("text_house")), bare_glosses(F.col("glosses_house"))).alias("canon"))


def canonical_objects(df: DataFrame, key: str, line: str, text: str, glosses: str) -> DataFrame:
    """Rows ``key, canon`` of the lines that are JSON objects: all fields in the order of their names, the two texts reduced."""
    v = df.select(F.col(key).alias("key"), F.expr(f"try_parse_json({line})").alias("v")).withColumn("kinds", F.expr("schema_of_variant(v)")).filter("kinds like 'OBJECT%'")
    fields = v.select("key", "kinds", F.from_json(F.to_json("v"), "map<string,string>").alias("m"))
    own = fields.select(
        "key",
        F.concat_ws("\n", "kinds", F.to_json(F.array_sort(F.map_entries(F.map_filter("m", lambda k, _: ~k.isin(text, glosses)))), {"ignoreNullFields": "false"})).alias("rest"),
        F.col("m")[text].alias("text"),
        F.col("m")[glosses].alias("glosses"),
    )
    house = house_columns(own, {"text": "text_house", "glosses": "glosses_house"})
    absent = F.lit("\x00")
    return house.select("key", F.concat_ws("\n", F.coalesce(bare(F.col("text_house")), absent), F.coalesce(bare_glosses(F.col("glosses_house")), absent), "rest").alias("canon"))


def radix_buckets(rows: DataFrame, bucket_rows: int = BUCKET_ROWS, step: int = STEP_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``rows`` (``tbl, key, bytes``) with ``bucket`` and ``salts``: a prefix of ``step`` bytes, or of twice as many again and again, that at most ``bucket_rows`` rows of ``bucket_bytes`` in all share.

    Only rows of oversized buckets are counted again. Where an oversized bucket holds one text only,
    ``salts`` says in how many parts its keys go.
    """
    left, done, depth = rows, [], step // 2
    while True:
        depth *= 2  # a long beginning that many texts share costs few rounds
        at = left.withColumn("bucket", F.substring("bytes", 1, depth))
        wide = at.groupBy("tbl", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("bytes")).alias("size"), (F.min("bytes") == F.max("bytes")).alias("one"))
        times = F.greatest(F.col("n") / bucket_rows, F.col("size") / bucket_bytes)
        wide = cut(wide.filter(times > 1).select("tbl", "bucket", F.when(F.col("one"), F.least(F.ceil(times), F.col("n"))).otherwise(0).cast("int").alias("salts")))
        if wide.isEmpty():
            done.append(at.withColumn("salts", F.lit(1)))
            break
        marked = at.join(wide, ["tbl", "bucket"], "left")
        done.append(marked.filter("salts is null or salts > 0").withColumn("salts", F.coalesce("salts", F.lit(1))))
        left = marked.filter("salts = 0").select(*rows.columns)
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One trie per bucket and salt, which come sorted; its terminals as rows."""

    def emit(tbl: str, salts: int, ends: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([tbl] * len(ends), pa.string()),
                pa.array([e[0] if salts > 1 else None for e in ends], pa.binary()),
                pa.array([e[2] for e in ends], pa.string()),
                pa.array([e[1] for e in ends], pa.int64()),
                pa.array([None if salts > 1 else e[3] for e in ends], pa.list_(pa.string())),
            ],
            names=["tbl", "bytes", "rep", "copies", "keys"],
        )

    now, root, ends = None, {}, []
    for batch in batches:
        for tbl, bucket, salts, salt, text, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (tbl, bucket, salt) != now:
                if ends:
                    yield emit(now[0], last, ends)
                now, last, root, ends = (tbl, bucket, salt), salts, {}, []
            node = root
            for i in range(0, len(text), STRIDE):
                node = node.setdefault(text[i : i + STRIDE], {})
            end = node.get(None)
            if end is None:
                end = node[None] = [text, 0, key, []]
                ends.append(end)
            end[1] += 1
            if key < end[2]:
                end[2] = key
            if salts == 1:
                end[3].append(key)
    if ends:
        yield emit(now[0], last, ends)


def collapse(rows: DataFrame, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Rows ``tbl, key, rep, copies``: each key of ``rows`` (``tbl, key, canon``) with the smallest key of its copies and their number.

    Null keys and null texts are left out; an empty text is a text like others. Repeated rows of one
    key count once.
    """
    own = cut(rows.filter("key is not null and canon is not null").select("tbl", "key", F.encode("canon", "utf-8").alias("bytes")).distinct())
    buckets = radix_buckets(own, bucket_rows, bucket_bytes=bucket_bytes).withColumn("salt", F.expr("pmod(xxhash64(key), salts)").cast("int"))
    order = ["tbl", "bucket", "salt"]
    placed = buckets.repartition(*order).sortWithinPartitions(*order).select("tbl", "bucket", "salts", "salt", "bytes", "key")
    ends = cut(placed.mapInArrow(_tries, "tbl string, bytes binary, rep string, copies long, keys array<string>"))
    plain = ends.filter("keys is not null").select("tbl", F.explode("keys").alias("key"), "rep", "copies")
    hot = ends.filter("keys is null").groupBy("tbl", "bytes").agg(F.min("rep").alias("rep"), F.sum("copies").alias("copies"))
    return plain.unionByName(own.join(hot, ["tbl", "bytes"]).select("tbl", "key", "rep", "copies"))
