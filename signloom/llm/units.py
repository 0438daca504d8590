"""Splits that keep related records together.

Records and the entities they name form a bipartite graph. Records that name the same entities are
one node from the start, numbered as it is written; minimum labels, which are such numbers, then go
from nodes to entities and back, with a jump along the label's own label, until nothing changes.
Units are assigned to splits so that the labels deviate least from the given shares: large units one
by one, small ones of a common label by cells of their hash within the stratum of that label, those
of any other label along their hashes within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from signloom.plans.durable import cut, release

#: Units above this share of all records are placed one by one: at most its inverse. Small ones share so many cells a label.
LARGE_SHARE = 0.0005
UNIT_CELLS = 2048
#: Labels whose strata are cells. Units of rarer ones are placed label by label, in parallel, by their running share of it.
LABELS = 64


def tidy(value: Column) -> Column:
    """Without surrounding white space and case; null where nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", "")), F.lit(""))


def named_entities(records: DataFrame, segments: DataFrame) -> DataFrame:
    """Rows ``id, entities``: the sorted entities that each record names; none for blank and missing values."""
    dialogue = F.nullif(F.regexp_replace(tidy(F.col("seg_uuid")), r"p\d+$", ""), F.lit(""))
    corpus = F.nullif(tidy(F.split_part(F.col("corpus_id"), F.lit("/"), F.lit(1))), F.lit(""))
    named = segments.select("id", F.explode(F.array_compact(F.array(F.concat(F.lit("d:"), dialogue), F.concat(F.lit("c:"), corpus)))).alias("e"))
    own = records.select("id", F.explode(F.array_compact(F.array(F.lit(""), F.concat(F.lit("g:"), tidy(F.col("group_key")))))).alias("e"))
    both = own.unionByName(named.join(records.select("id").distinct(), "id", "left_semi"))
    return both.filter("id is not null").groupBy("id").agg(F.array_sort(F.array_remove(F.collect_set("e"), "")).alias("entities"))


def units(records: DataFrame, segments: DataFrame) -> DataFrame:
    """Rows ``id, unit``: each record with the smallest id of its unit.

    Null ids are left out, repeated ids come out once with all they name. A record that names nothing
    is a unit of its own.
    """
    named = cut(named_entities(records, segments))
    nodes = named.filter(F.size("entities") > 0).groupBy("entities").agg(F.min("id").alias("name"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    entity = F.struct(F.xxhash64("e").alias("h"), F.xxhash64(F.lit(0x5EED), "e").alias("g"))  # 128 bits stand for its text
    labels = propagate(nodes.select("node", F.explode("entities").alias("e")).select("node", entity.alias("entity")))
    told = nodes.join(labels, "node")
    unit = told.groupBy("label").agg(F.min("name").alias("unit"))
    placed = named.join(told.join(unit, "label").select("entities", "unit"), "entities").select("id", "unit")
    return placed.unionByName(named.filter(F.size("entities") == 0).select("id", F.col("id").alias("unit")))


def propagate(edges: DataFrame) -> DataFrame:
    """Rows ``node, label``: the smallest node of each component of ``edges`` (``node, entity``)."""
    # an entity of one node ties nothing
    shared = edges.groupBy("entity").agg(F.min("node").alias("label"), F.max("node").alias("most")).filter("label <> most").select("entity", "label")
    edges = cut(edges.join(shared.select("entity"), "entity", "left_semi").unionByName(edges.groupBy("node").agg(F.min("entity").alias("entity")).select("node", "entity")).distinct())
    labels, old = edges.select("node").distinct().withColumn("label", F.col("node")), None
    while True:
        by_entity = edges.join(labels, "node").groupBy("entity").agg(F.min("label").alias("label"))
        step = edges.join(by_entity, "entity").groupBy("node").agg(F.min("label").alias("label"))
        ahead = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = step.join(ahead, "label").select("node", F.col("further").alias("label"), F.col("label").alias("near"))
        new = cut(jumped.join(labels.withColumnRenamed("label", "before"), "node").select("node", "label", (F.col("label") != F.col("before")).alias("moved")))
        labels = new.select("node", "label")
        if old is not None:
            release(old)
        old = new
        if new.filter("moved").isEmpty():
            return labels


def place(items: list[tuple[str, dict[str, int]]], shares: dict[str, float]) -> dict[str, str]:
    """A split for each item (name, records by label), largest first: the one that leaves the least squared deviation of all labels."""
    totals: dict[str, int] = {}
    for _, counts in items:
        for label, n in counts.items():
            totals[label] = totals.get(label, 0) + n
    whole = sum(shares.values()) or 1.0
    target = {s: {x: share / whole * n for x, n in totals.items()} for s, share in shares.items()}
    now = {s: dict.fromkeys(totals, 0) for s in shares}
    placed = {}
    for name, counts in sorted(items, key=lambda i: (-sum(i[1].values()), i[0])):
        added = lambda s: sum(n * (n + 2 * (now[s][x] - target[s][x])) / (target[s][x] + 1) for x, n in counts.items())  # noqa: E731, B023
        best = min(sorted(shares), key=added)
        placed[name] = best
        for x, n in counts.items():
            now[best][x] += n
    return placed


def assign(placed: DataFrame, labels: DataFrame, shares: DataFrame) -> DataFrame:
    """Rows ``id, unit, split`` for the rows ``id, unit`` of ``placed``; whole units, near the shares for every label.

    ``labels`` has ``id, label``, null being a label of its own; ``shares`` has ``split, share``. Without
    shares every split is null. What goes to the driver is bounded: ``LABELS`` labels, and their counts
    in large units and cells.
    """
    spark = placed.sparkSession
    given = {r["split"]: float(r["share"] or 0) for r in shares.filter("split is not null").select("split", "share").collect()}
    if not given:
        return placed.withColumn("split", F.lit(None).cast("string"))
    named = placed.join(labels.select("id", F.coalesce("label", F.lit("")).alias("label")).dropDuplicates(["id"]), "id", "left").fillna("", ["label"])
    sizes = cut(named.groupBy("unit", "label").agg(F.count(F.lit(1)).alias("n")))
    common = sizes.groupBy("label").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "label").limit(LABELS)
    known = spark.createDataFrame([(r["label"],) for r in common.collect()], "label string").withColumn("common", F.lit(True))
    total = sizes.agg(F.sum("n").alias("n")).first()["n"] or 0
    whole = sizes.groupBy("unit").agg(F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("most")).select("unit", "size", F.col("most.label").alias("label"))
    large = F.col("size") > max(1.0, LARGE_SHARE * total)
    cell = F.when(large, F.concat(F.lit("u"), "unit")).when(F.col("common"), F.concat_ws("/", F.lit("c"), F.expr(f"pmod(xxhash64(unit), {UNIT_CELLS})"), "label"))
    cells = cut(whole.join(F.broadcast(known), "label", "left").select("unit", "size", "label", cell.alias("cell")))
    items: dict[str, dict[str, int]] = {}
    counts = sizes.join(cells.filter("cell is not null").select("unit", "cell"), "unit").join(F.broadcast(known), "label", "left")
    for r in counts.groupBy("cell", F.when(F.col("common"), F.col("label")).otherwise("\x00").alias("label")).agg(F.sum("n").alias("n")).collect():
        items.setdefault(r["cell"], {})[r["label"]] = r["n"]
    chosen = spark.createDataFrame([*place([*items.items()], given).items()], "cell string, split string")
    rare = cells.filter("cell is null").select("unit", running_share(given).alias("split"))
    split_of = cells.join(F.broadcast(chosen), "cell").select("unit", "split").unionByName(rare)
    return placed.join(split_of, "unit").select("id", "unit", "split")


def running_share(given: dict[str, float]) -> Column:
    """The split of a unit (``unit, size, label``) by the share of its label that goes before it along the units' hashes.

    Each label begins at a place of its own, so labels of one unit don't all go to the largest split.
    """
    order = Window.partitionBy("label").orderBy(F.xxhash64("unit"), "unit")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2
    start = F.xxhash64(F.lit(7), "label").cast("double") / 2.0**64 + 0.5
    place_of = F.pmod(before / F.sum("size").over(Window.partitionBy("label")) + start, F.lit(1.0))
    whole, reached, split = sum(given.values()) or 1.0, 0.0, None
    for name in sorted(given)[:-1]:
        reached += given[name] / whole
        split = F.when(place_of < reached, name) if split is None else split.when(place_of < reached, name)
    last = F.lit(sorted(given)[-1])
    return last if split is None else split.otherwise(last)
