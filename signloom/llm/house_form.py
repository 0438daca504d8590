"""Texts that read alike are brought to one written form.

House form: Han characters as unified ideographs, Latin letters as ordinary composed letters, the
ordinary space, ``/`` between glosses and full-width marks. Texts are exploded to positioned code
points, joined (broadcast) with decomposition and look-alike mappings, combining marks are put in
the order of their classes and recomposed, and the strings are rebuilt. Only texts that hold a
code point outside the house repertoire are exploded; all others are their own house form.

The mapping tables are built by rule from the Unicode database that ships with Python; they have a
few thousand rows whatever the data, so broadcasting them is bounded.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Look-alike letters of Greek and Cyrillic, and the Latin letters they read as.
LOOK_ALIKE = dict(
    zip(
        "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυχ" + "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁһԛԝӏ",
        "ABEZHIKMNOPTYXaivopux" + "ABESIJKMHOPCTYXaesijopcyxdhqwl",
        strict=True,
    )
)
# Marks that house form writes full-width, and other characters read as ``/``.
FULL_MARKS = dict(zip(",?!:;()_", "，？！：；（）＿", strict=True))
SLASHES = "／⁄∕⧸"
# Supplementary radicals and phonetic letters without a decomposition, and the characters they read as.
RADICALS = dict(zip("⻁⻄⻅⻆⻉⻋⻑⻓⻔⻘⻙⻚⻛⻜⻝⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻲", "虎西见角贝车長长门青韦页风飞食马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龜亀", strict=True)) | {"ɑ": "a", "ɡ": "g"}
# Characters without a glyph.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u206a\u206b\u206c\u206d\u206e\u206f\u3164\ufeff\uffa0"
SELECTORS = [*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
# By rule: ligatures and digraphs of Latin letters in one code point, and the letters they read as.
LIGATURES = {
    chr(cp): letters
    for cp in [*range(0x100, 0x250), *range(0xFB00, 0xFB07)]
    if unicodedata.decomposition(chr(cp)).startswith("<compat>")
    and len(letters := unicodedata.normalize("NFKC", chr(cp))) > 1
    and all("LATIN" in unicodedata.name(x) for x in letters)
}
ZWJ, EMOJI_STYLE = "\u200d", ("\ufe0e", "\ufe0f")
EMOJI_CLASS = r"[\x{203C}\x{2049}\x{2122}\x{2139}\x{2190}-\x{2BFF}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F000}-\x{1FAFF}]"


# The ranges whose code points are house form whatever stands beside them. Others call for a look.
HOUSE_CLASS = (
    r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3001}-\x{301C}，。？！：；（）＿\t-\r *+\-./0-9<=>@-\^`-~"
    r"\x22-\x27\x{A1}-\x{AC}\x{AE}-\x{131}\x{134}-\x{1C3}\x{1CD}-\x{1F0}\x{1F4}-\x{24F}\x{1E00}-\x{1EFF}\x{3041}-\x{3096}\x{309D}\x{309E}\x{30A1}-\x{30FE}"
    r"\x{2010}\x{2012}-\x{2027}\x{2190}-\x{2214}\x{2216}-\x{2328}\x{232B}-\x{29F7}\x{29F9}-\x{2ADB}\x{2ADD}-\x{2BFF}\x{1F000}-\x{1FAFF}\x{AC00}-\x{D7A3}"
)
#: A low line that is no part of a variant suffix such as ``_A`` or ``_c2``.
BLANK_LINE = r"_(?![A-Za-z]{1,2}[0-9]?(?:\+\+)?\s*(?:[/／⁄∕]|$))"
REBUILD = f"[^{HOUSE_CLASS}_]|{BLANK_LINE}"


@lru_cache(1)
def _tables() -> tuple[list, list]:
    """Rows (ch, out, ccc, part, latin) of the mapping and rows (parts, ch) of the composition."""
    marks = {*FULL_MARKS.values(), *"。、「」"}
    maps: dict[str, str] = {}
    compose: dict[str, str] = {}
    for cp in range(0xA0, 0x30000):
        if 0xAC00 <= cp < 0xD7A4 or 0xD800 <= cp < 0xF900:
            continue
        ch = chr(cp)
        how = unicodedata.decomposition(ch)
        if unicodedata.category(ch) == "Zs":
            maps[ch] = " "
        elif ch in SLASHES:
            maps[ch] = "/"
        elif ch in marks or not how:
            pass
        elif how[0] != "<":
            maps[ch] = unicodedata.normalize("NFD", ch)
            if unicodedata.normalize("NFC", ch) == ch:
                compose[maps[ch]] = ch
        elif how.split(">")[0] in ("<wide", "<narrow", "<font", "<noBreak") or 0x2E80 <= cp < 0x2FE0:
            out = unicodedata.normalize("NFKC", ch)
            maps[ch] = FULL_MARKS.get(out, unicodedata.normalize("NFD", out))
        elif how.split(">")[0] in ("<small", "<vertical"):
            out = "".join(chr(int(x, 16)) for x in how.split()[1:])
            maps[ch] = FULL_MARKS.get(out, out)
    maps |= RADICALS | dict.fromkeys([*INVISIBLE, *map(chr, SELECTORS)], "") | {a: b for a, b in FULL_MARKS.items() if a != "_"}
    every = {*maps, *LOOK_ALIKE, *map(chr, range(0x300, 0x370))} | {c for v in maps.values() for c in v}
    rows = [
        (ch, piece, unicodedata.combining(piece) if piece else 0, part, LOOK_ALIKE.get(piece))
        for ch in sorted(every)
        for part, piece in enumerate(maps.get(ch, ch) or [""])
    ]
    return rows, sorted(compose.items())


def needs_rebuild(text: Column) -> Column:
    """Whether a text holds any code point that house form might write otherwise."""
    return text.rlike(REBUILD)


def house_form(df: DataFrame, keys: Sequence[str], text: str, out: str = "house") -> DataFrame:
    """Rows ``keys, text, out``: each row's text with its house form.

    Nulls: a null text has a null house form; null keys are kept. Empty texts stay empty. Repeated
    rows come out as often as they go in. Columns besides ``keys`` and ``text`` are left out, so
    their names cannot clash. Very long texts are exploded like others.
    """
    return house_columns(df.select(*keys, text), {text: out})


def house_columns(df: DataFrame, outs: dict[str, str]) -> DataFrame:
    """``df`` with the house form of each text column of ``outs`` under its new name; every row comes out once.

    Rows without a code point to look at pass straight through. Null texts have a null house form.
    """
    look = _looked_at(outs)
    clean = df.filter(~look).withColumns({o: F.col(c) for c, o in outs.items()})
    return clean.unionByName(rebuilt(df.filter(look), outs))


def _looked_at(columns: Iterable[str]) -> Column:
    return F.greatest(*[F.coalesce(needs_rebuild(F.col(c)), F.lit(False)) for c in columns], F.lit(False))


def bare(house: Column) -> Column:
    """Letters and digits only, without case."""
    return F.lower(F.regexp_replace(house, r"[^\p{L}\p{N}]+", ""))


def bare_glosses(house: Column) -> Column:
    """The same gloss by gloss, empty ones dropped."""
    slashed = F.regexp_replace(F.lower(F.regexp_replace(house, r"[^\p{L}\p{N}/]+", "")), "/+", "/")
    return F.regexp_replace(slashed, "^/|/$", "")


def rebuilt(dirty: DataFrame, outs: dict[str, str]) -> DataFrame:
    """``dirty`` with the house form of each text column of ``outs``, from the exploded pieces of the texts.

    Rows are numbered; pieces carry the number only. The columns of a row travel once, with a piece of
    their own, so a text of any length costs bytes in proportion.
    """
    spark: SparkSession = dirty.sparkSession
    mapping, compose = _tables()
    maps = F.broadcast(spark.createDataFrame(mapping, "__ch string, __out string, __ccc int, __part int, __latin string"))
    composed = F.broadcast(spark.createDataFrame(compose, "__whole string, __one string"))
    letter = r"\p{IsLatin}\p{IsGreek}\p{IsCyrillic}"
    unseen = r"\p{M}\x{AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}"

    def words(column: str) -> Column:
        spelled = F.col(column)
        for one, letters in LIGATURES.items():  # before the cut into bases with their marks: a mark stands on the last letter
            spelled = F.replace(spelled, F.lit(one), F.lit(letters))
        return F.regexp_extract_all(spelled, F.lit(f"[{letter}][{letter}{unseen}]*|[^{letter}]+"), F.lit(0))

    whole_row = F.struct(*[F.col(c) for c in dirty.columns])
    nothing = F.lit(None).cast(T.StructType(dirty.schema.fields))
    run = lambda f, text, row: F.struct(F.lit(f).alias("f"), text.alias("run"), row.alias("row"))
    of_field = lambda f: lambda w: run(f, w, nothing)
    runs = [F.array(run(-1, F.lit(None).cast("string"), whole_row))]
    for f, column in enumerate(outs):
        runs.append(F.when(needs_rebuild(F.col(column)), F.transform(words(column), of_field(f))).otherwise(F.array().cast(runs_type(dirty))))
    # a stretch that is house form whatever stands beside it travels as one piece
    clusters = F.regexp_extract_all(F.col("x.run"), F.lit(f"(?:[{HOUSE_CLASS}](?![{unseen}]))+|(?s:.)[{unseen}]*"), F.lit(0))
    with_next = F.arrays_zip(clusters.alias("c"), F.slice(clusters, 2, F.greatest(F.size(clusters), F.lit(1))).alias("n"))
    no_text = F.array(F.struct(F.lit("").alias("c"), F.lit(None).cast("string").alias("n")))
    pieces = F.when(F.col("y.c").rlike(f"^[{HOUSE_CLASS}]*$"), F.array("y.c")).otherwise(F.split("y.c", ""))
    points = (
        dirty.withColumn("__row", F.monotonically_increasing_id())  # before the generator: one number a row
        .repartition("__row")  # the rows are shuffled once; their pieces, which are many more, never
        .select("__row", F.posexplode(F.concat(*runs)).alias("__seg", "x"))
        .withColumn("__mixed", F.col("x.run").rlike(r"\p{IsLatin}") & F.col("x.run").rlike(r"[\p{IsGreek}\p{IsCyrillic}]"))
        .select("__row", "__seg", "__mixed", F.col("x.f").alias("__f"), F.col("x.row").alias("__rest"), F.posexplode(F.when(F.col("x.run").isNull(), no_text).otherwise(with_next)).alias("__at", "y"))
        .select("__row", "__seg", "__mixed", "__f", "__rest", "__at", F.col("y.c").alias("__cluster"), F.col("y.n").alias("__next"), F.posexplode(pieces).alias("__k", "__ch"))
    )
    on_emoji = F.col("__cluster").rlike(f"^{EMOJI_CLASS}")
    joiner = (F.col("__ch") == ZWJ) & on_emoji & F.col("__cluster").rlike(f"{ZWJ}$") & F.col("__next").rlike(f"^{EMOJI_CLASS}")
    style = F.col("__ch").isin(*EMOJI_STYLE) & (F.col("__k") == 1) & (on_emoji | F.col("__cluster").rlike(r"^[0-9#*].?\x{20E3}"))
    piece = (
        F.when(joiner | style, F.col("__ch"))
        .when(F.col("__mixed") & F.col("__latin").isNotNull(), F.col("__latin"))
        .otherwise(F.coalesce("__out", "__ch"))
    )
    mapped = points.join(maps, "__ch", "left")
    item = F.struct(F.coalesce("__ccc", F.lit(0)).alias("c"), F.col("__k").alias("k"), F.coalesce("__part", F.lit(0)).alias("p"), piece.alias("s"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]), "")
    joined = mapped.groupBy("__row", "__seg", "__at").agg(whole.alias("__whole"), F.first("__f").alias("__f"), F.first("__rest", True).alias("__rest"))
    for n in (4, 3, 2):  # a base with three, two or one of its marks has one code point
        size = F.length("__whole")
        part = F.when(size >= n, F.substring("__whole", 1, n)) if n > 2 else F.when(size >= 2, F.substring("__whole", 1, 2))
        joined = joined.withColumn(f"__p{n}", part).join(composed.withColumnsRenamed({"__whole": f"__p{n}", "__one": f"__c{n}"}), f"__p{n}", "left")
    # a base that takes its second mark but not its first keeps the first
    joined = joined.withColumn("__skip", F.when(F.length("__whole") >= 3, F.concat(F.substring("__whole", 1, 1), F.substring("__whole", 3, 1)))).join(
        composed.withColumnsRenamed({"__whole": "__skip", "__one": "__cs"}), "__skip", "left"
    )
    rest = lambda n: F.expr(f"substring(__whole, {n + 1})")
    best = F.coalesce(
        *(F.concat(F.col(f"__c{n}"), rest(n)) for n in (4, 3, 2)), F.concat(F.col("__cs"), F.substring("__whole", 2, 1), rest(3)), F.col("__whole")
    )
    rows = joined.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("__f", "__seg", "__at", best.alias("s")))).alias("__all"), F.first("__rest", True).alias("__rest"))
    columns = [F.col(f"__rest.`{c}`").alias(c) for c in dirty.columns]
    is_field = lambda f: lambda x: x["__f"] == f
    for f, (column, out) in enumerate(outs.items()):
        own = F.filter("__all", is_field(f))
        text = F.regexp_replace(F.array_join(F.transform(own, lambda x: x["s"]), ""), BLANK_LINE, "＿")
        columns.append(F.when(F.size(own) > 0, text).otherwise(F.col(f"__rest.`{column}`")).alias(out))
    return rows.select(*columns)


def runs_type(dirty: DataFrame) -> T.ArrayType:
    """Stretches of a row's texts: the number of the field, the stretch, and, for one of them, the whole row."""
    return T.ArrayType(T.StructType([T.StructField("f", T.IntegerType()), T.StructField("run", T.StringType()), T.StructField("row", T.StructType(dirty.schema.fields))]))


def disguised(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Rows ``id, field``: the records and fields whose text is not in house form.

    Null and empty texts are in house form. A repeated key and field counts once.
    """
    own = df.select(F.col(key).alias("id"), *[F.col(f).alias(f"__t{n}") for n, f in enumerate(fields)])
    outs = {f"__t{n}": f"__h{n}" for n in range(len(fields))}
    house = rebuilt(own.filter(_looked_at(outs)), outs)
    each = F.array(*[F.struct(F.lit(f).alias("field"), (F.col(f"__h{n}") != F.col(f"__t{n}")).alias("other")) for n, f in enumerate(fields)])
    return house.select("id", F.explode(each).alias("x")).filter("x.other").select("id", "x.field").distinct()
