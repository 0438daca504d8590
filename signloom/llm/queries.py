"""Queries of the training-data operators over whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signloom.llm import answers, canonical, copies, house_form, overlap, packing, residue, term_counts, tokens, units
from signloom.plans.durable import cut, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return house_form.disguised(table(spark, root, "tsl_sentences"), "id", ["chinese", "gloss_text"])


@query
def p1_house(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "tsl_sentences").select("id", "chinese", "gloss_text")
    return house_form.house_columns(rows, {"chinese": "chinese_house", "gloss_text": "gloss_text_house"}).drop("chinese", "gloss_text")


@query
def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return canonical.map_tokens(table(spark, root, "tsl_sentences"), "id", "gloss", table(spark, root, "gloss_master"))


@query
def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return term_counts.mark_terms(table(spark, root, "tsl_sentences"), "gloss").filter("mark is not null").select("term", "mark")


@query
def p3_term_counts(spark: SparkSession, root: str) -> DataFrame:
    return term_counts.mark_terms(table(spark, root, "tsl_sentences"), "gloss").withColumn("mark", F.coalesce("mark", F.lit("")))


_TERMS = """
with spread as (select id, unnest(gloss) as term from tsl_sentences),
terms as (select * from spread where term is not null and not regexp_full_match(term, '[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]*')),
counts as (select term, count(*)::bigint as occurrences, count(distinct id)::bigint as records from terms group by term),
marked as (select term, occurrences, records, case when records < 3 then 'rare' when records > 0.1 * (select count(*) from tsl_sentences) then 'common' else '' end as mark from counts)
"""
ORACLES["p3_found"] = _TERMS + "select term, mark from marked where mark <> ''"
ORACLES["p3_term_counts"] = _TERMS + "select term, occurrences, records, mark from marked"


def _copies(spark: SparkSession, root: str) -> DataFrame:
    pairs = copies.canonical_pairs(table(spark, root, "tsl_sentences"), "id", "chinese", "gloss_text").withColumn("tbl", F.lit("tsl_sentences"))
    lines = copies.canonical_objects(table(spark, root, "sentence_lines"), "line_id", "line", "chinese", "gloss_text").withColumn("tbl", F.lit("sentence_lines"))
    return copies.collapse(pairs.unionByName(lines))


@query
def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return _copies(spark, root).filter("key <> rep").select("tbl", F.col("rep").alias("key_a"), F.col("key").alias("key_b"))


@query
def p7_collapsed(spark: SparkSession, root: str) -> DataFrame:
    return _copies(spark, root).filter("key = rep").select("tbl", "key", "copies")


@query
def p6_found(spark: SparkSession, root: str) -> DataFrame:
    found = units.units(table(spark, root, "split_data"), table(spark, root, "scrape_tslcorpus_full"))
    return found.filter("id <> unit").select(F.col("unit").alias("id_a"), F.col("id").alias("id_b"))


@query
def p6_split(spark: SparkSession, root: str) -> DataFrame:
    records = table(spark, root, "split_data")
    found = cut(units.units(records, table(spark, root, "scrape_tslcorpus_full")))
    return units.assign(found, records.select("id", F.col("source").alias("label")), table(spark, root, "split_ratio"))


@query
def p5_found(spark: SparkSession, root: str) -> DataFrame:
    pairs = overlap.cross_split_pairs(table(spark, root, "tsl_sentences"), "id", "split", ["chinese", "gloss_text"])
    return pairs.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


@query
def p5_by_split_and_source(spark: SparkSession, root: str) -> DataFrame:
    return overlap.cross_split_counts(table(spark, root, "tsl_sentences"), "id", "split", "source", ["chinese", "gloss_text"])


def tokenizer_file(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    """Path of a public tokenizer's file, in ``folder`` or where the tokenizers are installed."""
    return os.path.join(folder or os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers"), name)


@query
def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return tokens.encode_texts(table(spark, root, "documents"), "doc_id", "text", tokenizer_file())


@query
def p9_packed(spark: SparkSession, root: str) -> DataFrame:
    sizes = tokens.count_tokens(table(spark, root, "documents"), "doc_id", "text", tokenizer_file())
    return packing.pack(sizes, "doc_id", "tokens", capacity=2048).withColumnRenamed("size", "tokens")


@query
def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return residue.judge(table(spark, root, "documents"), "doc_id", "text").filter("is_residue").select("doc_id").distinct()


@query
def p10_kept(spark: SparkSession, root: str) -> DataFrame:
    return residue.judge(table(spark, root, "documents"), "doc_id", "text").filter("not is_residue").select("doc_id")


@query
def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return answers.defects(table(spark, root, "finetuned_e4b_ep2_test"), "id", "chinese", "ref", "raw", table(spark, root, "gloss_master"), pred="pred")

_UNIT = r"nullif(lower(regexp_replace({}, '^[\s\x{{85}}\x{{a0}}\x{{3000}}]+|[\s\x{{85}}\x{{a0}}\x{{3000}}]+$', '', 'g')), '')"
ORACLES["p6_found"] = f"""
with recursive s as (select id, {_UNIT.format('seg_uuid')} as d, {_UNIT.format("split_part(corpus_id, '/', 1)")} as c from scrape_tslcorpus_full where id in (select id from split_data)),
e as (select id, 'g:' || {_UNIT.format('group_key')} as ent from split_data union select id, 'd:' || nullif(regexp_replace(d, 'p\\d+$', ''), '') from s union select id, 'c:' || c from s),
adj as (select distinct a.id as x, b.id as y from e a join e b using (ent) where a.id <> b.id),
reach as (select id as x, id as y from split_data union select r.x, a.y from reach r join adj a on r.y = a.x),
u as (select y as id, min(x) as unit from reach group by y)
select unit as id_a, id as id_b from u where id <> unit
"""
