"""Records of evaluation splits that also stand, exactly or almost, in the training split.

Equal texts become one class first. Classes get minwise hashes of their pairs of adjacent characters,
in bands; a band's key is a bucket. Bands are taken in as many passes as keep a pass's bitmap of the
evaluation side's keys sparse: rows that can meet nobody of the other side aren't shuffled, and what
a pass writes is removed before the next. Buckets join across splits only, those of many pairs in a
grid of salts; a 128-bit sketch of the same hashes turns most chance meetings away before exact
Jaccard similarity is computed from the texts.

``BANDS`` x ``ROWS`` lose a pair of similarity 0.7 with probability (1 - 0.7 ** 4) ** 24 = 0.0014, one of
0.75 with 0.0001, and the sketch one of 0.7 with some 0.00005 (40 of 128 bits, 19 expected, standard deviation 4.8); there is no cap on buckets or candidates.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signloom.llm.house_form import bare, house_columns
from signloom.plans.durable import cut, release, sweep

BANDS, ROWS = 24, 4
SKETCH_DIFFERENT = 40
#: A bitmap has 16 bits a key, but no more than 2 to this power; passes are added until it has 4. There are so many at least,
#: for what a pass writes and shuffles to be a part of the input.
FILTER_BITS, LEAST_PASSES = 28, 2
CHUNK = 4096
#: Pairs in a bucket above which it is split into a grid, rows of either side in a cell of it, and buckets split so at once.
#: Which buckets are split changes where rows meet, never which.
BUCKET_PAIRS, CELL_ROWS, SPLIT_BUCKETS = 1 << 20, 1024, 1 << 14
SIMILAR = 0.7

_SEED = np.random.default_rng(20250301)
_FACTORS = (_SEED.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)).astype(np.uint32)
_SHIFTS = _SEED.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_BAND = _SEED.integers(0, 2**63, BANDS, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pairs of adjacent characters of all texts (of two or more) in a row, and where each text's begin."""
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    lengths = pc.utf8_length(texts).to_numpy().astype(np.int64)
    inner = np.ones(len(points), bool)
    inner[np.cumsum(lengths) - 1] = False
    first = np.flatnonzero(inner)
    pair = (_mix((points[first].astype(np.uint64) << np.uint64(32)) | points[first + 1]) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return pair, np.concatenate([[0], np.cumsum(lengths - 1)[:-1]])


def _least(pair: np.ndarray, starts: np.ndarray, i: int) -> np.ndarray:
    return np.minimum.reduceat(pair * _FACTORS[i] + _SHIFTS[i], starts)


def _band_keys(texts: pa.Array, fields: np.ndarray, bands: Sequence[int]) -> np.ndarray:
    """The keys of ``bands`` (texts x bands)."""
    pair, starts = _pairs(texts)
    keys, own = np.empty((len(starts), len(bands)), np.uint64), _mix(fields.astype(np.uint64))
    for at, band in enumerate(bands):
        key = own ^ _BAND[band]
        for row in range(ROWS):
            key = _mix(key * np.uint64(31) + _least(pair, starts, band * ROWS + row))
        keys[:, at] = key
    return keys


def _sketches(texts: pa.Array) -> list[np.ndarray]:
    """Both halves of the texts' sketches: two bits of each of 64 hashes."""
    pair, starts = _pairs(texts)
    halves = [np.zeros(len(starts), np.uint64) for _ in range(2)]
    for i in range(64):
        spread = _least(pair, starts, i) * np.uint32(0x9E3779B1)
        for half, bit in enumerate((31, 30)):
            halves[half] |= ((spread >> np.uint32(bit)) & np.uint32(1)).astype(np.uint64) << np.uint64(i)
    return halves


class Keys:
    """What a side's keys of a pass are: a bitmap of their leading bits, and the counts of those that stand in most rows."""

    def __init__(self, bits: int, bitmap: bytes, often: dict[int, int]) -> None:
        self.bits, self.bitmap, self.often = bits, bitmap, often


def _held(keys: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    at = keys >> np.uint64(64 - bits)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _summary(keys: Iterator[np.ndarray], bits: int, least: int) -> Iterator[pa.RecordBatch]:
    """The non-empty chunks of a task's bitmap, and its most frequent keys with their counts (chunk -1)."""
    bitmap = np.zeros(max(2**bits // 8, CHUNK), np.uint8)
    often = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for some in keys:
        at = some >> np.uint64(64 - bits)
        np.bitwise_or.at(bitmap, at >> np.uint64(3), (1 << (at & np.uint64(7))).astype(np.uint8))
        own, n = np.unique(some, return_counts=True)
        own, inverse = np.unique(np.concatenate([often[0], own[n > 1]]), return_inverse=True)
        n = np.bincount(inverse, np.concatenate([often[1], n[n > 1]]), len(own)).astype(np.int64)
        most = np.argsort(-n, kind="stable")[:SPLIT_BUCKETS]
        often = own[most], n[most]
    chunks = bitmap.reshape(-1, CHUNK)
    used = np.flatnonzero(chunks.any(axis=1))
    names, many = ["chunk", "bits", "key", "n"], often[1] >= least
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([chunks[i].tobytes() for i in used], pa.binary()), pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.int64())], names=names)
    k, n = often[0][many], often[1][many]
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), -1), pa.int32()), pa.nulls(len(k), pa.binary()), pa.array(k.view(np.int64)), pa.array(n)], names=names)


def keys_of(df: DataFrame, bits: int, bands: Sequence[int] = range(BANDS)) -> Keys:
    """``Keys`` of the rows of ``df``: of its column ``key``, or of ``bands`` of its texts. The driver gets 2 ** bits bits and ``SPLIT_BUCKETS`` counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "key" in batch_columns:
            yield from _summary((b.column(0).to_numpy().view(np.uint64) for b in batches if b.num_rows), bits, least)
        else:
            yield from _summary((_band_keys(b.column(0), b.column(1).to_numpy(), bands).ravel() for b in batches if b.num_rows), bits, least)

    batch_columns, least = ["key"] if "key" in df.columns else ["text", "field"], max(2, CELL_ROWS // 64)
    rows = df.select(*batch_columns).mapInArrow(run, "chunk int, bits binary, key long, n long")
    merged = rows.groupBy("chunk", "key").agg(F.expr("bitmap_or_agg(bits)").alias("bits"), F.sum("n").alias("n"))
    bitmap = bytearray(max(2**bits // 8, CHUNK))
    most = merged.filter("key is not null").orderBy(F.desc("n")).limit(SPLIT_BUCKETS)
    often = {}
    for row in merged.filter("key is null").unionByName(most).collect():
        if row["key"] is None:
            bitmap[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = row["bits"]
        else:
            often[row["key"]] = row["n"]
    return Keys(bits, bytes(bitmap), often)


def with_sketches(classes: DataFrame) -> DataFrame:
    """``classes`` with ``s`` and ``t``, their sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s, t = _sketches(batch.column("text"))
                yield batch.append_column("s", pa.array(s.view(np.int64))).append_column("t", pa.array(t.view(np.int64)))

    return classes.mapInArrow(run, classes.withColumns({"s": F.lit(0).cast("long"), "t": F.lit(0).cast("long")}).schema)


def bucket_rows(classes: DataFrame, bands: Sequence[int], other: Keys) -> DataFrame:
    """Rows ``key, cid, s, t`` of each of ``bands`` of each class, ``s`` and ``t`` its sketch; only those whose key the other side may hold."""
    shared, bits = classes.sparkSession.sparkContext.broadcast(other.bitmap), other.bits

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(shared.value, np.uint8)
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                flat = _band_keys(batch.column("text"), batch.column("field").to_numpy(), bands).ravel()
                may = np.flatnonzero(_held(flat, seen, bits))
                of = pa.array(may // len(bands))
                yield pa.RecordBatch.from_arrays([pa.array(flat[may].view(np.int64)), *(batch.column(c).take(of) for c in ("cid", "s", "t"))], names=["key", "cid", "s", "t"])

    return classes.select("cid", "field", "text", "s", "t").mapInArrow(rows, "key long, cid long, s long, t long")


def _filtered(texts: DataFrame, ids: Keys) -> DataFrame:
    """Rows of ``texts`` whose ``cid`` the bitmap may hold; others are not shuffled."""
    shared, bits = texts.sparkSession.sparkContext.broadcast(ids.bitmap), ids.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            yield batch.filter(pa.array(_held(_mix(batch.column("cid").to_numpy().view(np.uint64)), seen, bits)))

    return texts.mapInArrow(run, texts.schema)


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for text, other in zip(batch.column("text").to_pylist(), batch.column("text_other").to_pylist(), strict=True):
            a, b = set(map(str.__add__, text, text[1:])), set(map(str.__add__, other, other[1:]))
            both = len(a & b)
            keep.append(both >= SIMILAR * (len(a) + len(b) - both) - 1e-9)
        yield batch.filter(pa.array(keep, pa.bool_())).select(["one", "other"])


def classes_and_members(df: DataFrame, key: str, split: str, fields: list[str], train: str, *more: str) -> tuple[DataFrame, DataFrame]:
    """Classes ``cid, h, g, field, text, in_train, in_eval, s, t`` of equal texts per field, and members ``h, g, field, id, is_train`` and ``more``.

    Classes are told by field and text and numbered; members find theirs by a hash of 128 bits.
    """
    long = df.select(F.col(key).alias("id"), F.coalesce(F.col(split) == train, F.lit(False)).alias("is_train"), *fields, *[F.col(c).alias(f"more_{c}") for c in more])
    house = house_columns(long, {f: f"{f}_house" for f in fields})
    each = F.array(*[F.struct(F.lit(i).cast("long").alias("field"), bare(F.col(f"{f}_house")).alias("text")) for i, f in enumerate(fields)])
    kept = ["id", "is_train", *[f"more_{c}" for c in more]]
    rows = house.select(*kept, F.explode(each).alias("x")).select(*kept, "x.field", "x.text").filter(F.length("text") > 1)
    members = cut(rows.select(*_hashes(F.col("field"), F.col("text")), "field", "text", *kept).filter("id is not null"))
    classes = members.groupBy("h", "g", "field", "text").agg(F.max("is_train").alias("in_train"), F.max(~F.col("is_train")).alias("in_eval"))
    numbered = cut(with_sketches(classes.withColumn("cid", F.monotonically_increasing_id())))
    del rows, house, classes
    sweep(df.sparkSession)
    return numbered, members.drop("text")


def _hashes(field: Column, text: Column) -> tuple[Column, Column]:
    return F.xxhash64(field, text).alias("h"), F.xxhash64(F.lit(0x5EED), text, field).alias("g")


def _bits(keys: int, each: int = 16) -> int:
    return min(FILTER_BITS, max(15, (each * max(keys, 1) - 1).bit_length()))


def _grid(spark: SparkSession, one: Keys, other: Keys) -> DataFrame | None:
    """Rows ``key, rows, columns`` of the buckets of many pairs, at most ``SPLIT_BUCKETS``; none where there are none."""
    most = ((k, n, other.often.get(k, 1)) for k, n in one.often.items())
    also = ((k, 1, n) for k, n in other.often.items() if k not in one.often)
    split = sorted((x for x in (*most, *also) if x[1] * x[2] > BUCKET_PAIRS), key=lambda x: -x[1] * x[2])[:SPLIT_BUCKETS]
    return spark.createDataFrame([(k, -(-m // CELL_ROWS), -(-n // CELL_ROWS)) for k, m, n in split], "key long, rows int, columns int") if split else None


def _met(left: DataFrame, right: DataFrame, grid: DataFrame | None) -> DataFrame:
    """Rows ``one, other``: classes of one bucket with like sketches. A bucket of the grid has a task for each cell."""
    keys = ["key"]
    if grid is not None:
        keys = ["key", "row", "column"]
        salt = lambda cid, n: F.pmod(F.xxhash64(cid), F.coalesce(n, F.lit(1))).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
        left = left.join(F.broadcast(grid), "key", "left").withColumn("row", salt("one", F.col("rows"))).select("*", every(F.col("columns")).alias("column")).drop("rows", "columns")
        right = right.join(F.broadcast(grid), "key", "left").withColumn("column", salt("other", F.col("columns"))).select("*", every(F.col("rows")).alias("row")).drop("rows", "columns")
    unlike = sum(F.bit_count(F.col(f"{h}_one").bitwiseXOR(F.col(f"{h}_other"))) for h in "st")
    return right.join(left, keys).filter((F.col("one") != F.col("other")) & (unlike <= SKETCH_DIFFERENT)).select("one", "other").distinct()


def candidates(classes: DataFrame) -> DataFrame:
    """Rows ``one, other``: a class of an evaluation split and a training class that meet in a bucket and have like sketches."""
    spark = classes.sparkSession
    known = classes.filter("in_eval").count() * BANDS
    passes = min(BANDS, max(LEAST_PASSES, -(-4 * known // 2**FILTER_BITS)))
    evaluation, training = classes.filter("in_eval"), classes.filter("in_train")
    parts = []
    for n in range(passes):
        bands = range(n * BANDS // passes, (n + 1) * BANDS // passes)
        bits = _bits(known // passes)
        ones = keys_of(evaluation, bits, bands)
        right = cut(bucket_rows(training, bands, ones).toDF("key", "other", "s_other", "t_other"))
        others = keys_of(right, bits)
        sweep(spark)
        left = bucket_rows(evaluation, bands, others).toDF("key", "one", "s_one", "t_one")
        parts.append(cut(_met(left, right, _grid(spark, ones, others))))
        release(right)
        del left, right
        sweep(spark)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return cut(whole.distinct())


def links(classes: DataFrame) -> DataFrame:
    """Rows ``one, other``: a class with evaluation records and one with training records that are alike; a class with both is like itself."""
    met = candidates(classes)
    sides = met.select("one", "other", F.explode(F.array(F.struct(F.col("one").alias("cid"), F.lit(True).alias("first")), F.struct(F.col("other").alias("cid"), F.lit(False).alias("first")))).alias("x")).select("one", "other", "x.cid", "x.first")
    ids = sides.select(F.col("cid").alias("key"))
    held = keys_of(ids.mapInArrow(_mixed, "key long"), _bits(2 * met.count()))
    both = sides.join(_filtered(classes.select("cid", "text"), held), "cid").groupBy("one", "other").agg(F.max(F.when(F.col("first"), F.col("text"))).alias("text"), F.max(F.when(~F.col("first"), F.col("text"))).alias("text_other"))
    alike = both.mapInArrow(_similar, "one long, other long")
    return cut(alike.unionByName(classes.filter("in_eval and in_train").select(F.col("cid").alias("one"), F.col("cid").alias("other"))))


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_mix(batch.column(0).to_numpy().view(np.uint64)).view(np.int64))], names=["key"])


def linked_members(linked: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` of the classes of ``linked``, with ``cid``."""
    ids = linked.select(F.explode(F.array("one", "other")).alias("cid")).distinct()
    return members.join(classes.join(ids, "cid", "left_semi").select("cid", "h", "g"), ["h", "g"]).drop("h", "g")


def cross_split_pairs(df: DataFrame, key: str, split: str, fields: list[str], train: str = "train") -> DataFrame:
    """Rows ``id, other``: a record of an evaluation split and one of ``train`` that are alike in one of ``fields``.

    Null and empty texts, and texts of fewer than two letters or digits, are like nothing. A null split
    is no training split; null ids are left out. Repeated rows make no repeated pairs.
    """
    classes, members = classes_and_members(df, key, split, fields, train)
    linked = links(classes)
    of = linked_members(linked, classes, members)
    one = of.filter("not is_train").select(F.col("cid").alias("one"), "id")
    other = of.filter("is_train").select(F.col("cid").alias("other"), F.col("id").alias("id_other"))
    return linked.join(one, "one").join(other, "other").select("id", F.col("id_other").alias("other")).distinct()


def cross_split_counts(df: DataFrame, key: str, split: str, source: str, fields: list[str], train: str = "train") -> DataFrame:
    """Rows ``split, source, pairs, records``: how many pairs of ``cross_split_pairs`` there are, and how many records of the split stand in one.

    Copies are counted, never paired: records with the same classes are one row with a number. Pairs
    alike in several fields count once, by inclusion and exclusion over the fields. Equal rows count
    once; ids are taken as unique else. Nulls as for ``cross_split_pairs``; a null source is a source.
    """
    classes, members = classes_and_members(df, key, split, fields, train, split, source)
    linked = links(classes)
    of = linked_members(linked, classes, members).withColumnsRenamed({f"more_{split}": "split", f"more_{source}": "source"})
    numbers = range(len(fields))
    # records by the classes they have in each field, null where a field has none that is linked
    records = of.groupBy("id", "is_train", "split", "source").agg(*[F.max(F.when(F.col("field") == n, F.col("cid"))).alias(f"c{n}") for n in numbers])
    kinds = cut(records.groupBy("is_train", "split", "source", *[f"c{n}" for n in numbers]).agg(F.count(F.lit(1)).alias("n")))
    ours, theirs = kinds.filter("not is_train").withColumn("kind", F.monotonically_increasing_id()), kinds.filter("is_train")
    ours = cut(ours.select("kind", "split", "source", "n", *[f"c{n}" for n in numbers]))
    counts = []
    for mask in range(1, 2 ** len(fields)):
        some = [n for n in numbers if mask >> n & 1]
        rest = theirs.groupBy(*[F.col(f"c{n}").alias(f"d{n}") for n in some]).agg(F.sum("n").alias("m"))
        joined = ours.select("kind", *[f"c{n}" for n in some])
        first, *more = some
        joined = joined.join(linked.toDF(f"c{first}", f"d{first}"), f"c{first}").join(rest, f"d{first}")
        for n in more:
            joined = joined.join(linked.toDF(f"c{n}", f"d{n}"), [f"c{n}", f"d{n}"])
        counts.append(joined.groupBy("kind").agg((F.sum("m") * (1 if len(some) % 2 else -1)).alias("m")))
    whole = counts[0]
    for part in counts[1:]:
        whole = whole.unionByName(part)
    met = ours.join(whole.groupBy("kind").agg(F.sum("m").alias("m")), "kind").filter("m > 0")
    return met.groupBy("split", "source").agg(F.sum(F.col("n") * F.col("m")).alias("pairs"), F.sum("n").alias("records"))
