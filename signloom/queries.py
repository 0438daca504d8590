"""Queries of the engine's operators over whole tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signloom.functions import arrays, text
from signloom.operators import checks, joins, metrics, order, vocabulary
from signloom.plans import corpus, prompts, split
from signloom.plans.durable import table
from signloom.sources import sinks
from signloom.sources.readers import dimension

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MARKERS = {"negation": ["不", "沒有", "沒"], "modal": ["要", "想", "可以", "會"], "time": ["今天", "明天", "昨天", "早上", "晚上"]}
KEYWORDS = [(1, "place", "圖書館"), (2, "place", "車站"), (3, "object", "電腦"), (4, "object", "手機"), (5, "food", "蛋糕"), (6, "talk", "說")]
TEMPLATES = [
    (1, "T1", ["{P}在{T}嗎？", "{T}有{P}嗎？"], ["{T}", "{P}", "有"], ["湯匙", "外套", "腳踏車"], ["今天", "明天"]),
    (2, "T2", ["我想買{P}。"], ["我", "{P}", "買", "想"], ["書包", "手機"], None),
    (3, "T3", ["沒有。"], ["沒有"], None, None),
]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# The same classes for the other dialect.
_WS = r"\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}"
_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def _tokens(column: str) -> str:
    return f"list_filter(string_split(translate({column}, '／', '/'), '/'), lambda t: regexp_matches(t, '[^{_WS}]'))"


_PAIRS = f"""pairs as (select row_number() over () as rid, coalesce({_tokens('ref')}, []) as ref, coalesce({_tokens('pred')}, []) as hyp from finetuned_e4b_ep2_test)"""
_GRAMS = """grams as (select rid, n, side, unnest(list_transform(range(1, len(x) - n + 2), lambda i: array_to_string(x[i : i + n - 1], '|'))) as g
  from (select rid, 'r' as side, ref as x from pairs union all select rid, 'h', hyp from pairs), (select unnest([1, 2, 3, 4]) as n) where len(x) >= n),
counted as (select rid, n, g, count(*) filter (side = 'h') as h, count(*) filter (side = 'r') as r from grams group by rid, n, g),
counts as (select k.n, coalesce(sum(least(h, r)), 0)::bigint as matches, coalesce(sum(h), 0)::bigint as total from (select unnest([1, 2, 3, 4])::int as n) k left join counted c using (n) group by k.n)"""
_BLEU = """bleu as (select case when min(case when n > 1 then matches + 1 else matches end) = 0 or min(case when n > 1 then total + 1 else total end) = 0 or any_value(hyp_len) = 0 then 0.0::double
  else (case when any_value(hyp_len) > any_value(ref_len) then 1.0::double else exp(1 - any_value(ref_len)::double / any_value(hyp_len)) end) * exp(sum(ln((case when n > 1 then matches + 1 else matches end)::double / (case when n > 1 then total + 1 else total end))) / 4) * 100 end as bleu
  from counts, (select sum(len(ref)) as ref_len, sum(len(hyp)) as hyp_len from pairs))"""
_LCS = """steps as (select rid, ref, hyp, 0 as i, list_transform(range(0, len(hyp) + 1), lambda x: 0::bigint) as line from pairs where len(ref) > 0 and len(hyp) > 0
  union all select rid, ref, hyp, i + 1, list_concat([0::bigint], list_transform(range(1, len(hyp) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(line[k + 1], case when hyp[k] = ref[i + 1] then line[k] + 1 else 0 end))))) from steps where i < len(ref)),
lcs as (select rid, line[len(hyp) + 1]::bigint as common from steps where i = len(ref)),
rouge as (select p.rid, coalesce(common, 0)::bigint as common, len(ref)::bigint as ref_len, len(hyp)::bigint as hyp_len, case when coalesce(common, 0) > 0 then 2 * common::double / (len(ref) + len(hyp)) else 0.0::double end as f1 from pairs p left join lcs using (rid))"""


def _pairs(spark: SparkSession, root: str) -> DataFrame:
    return metrics.pairs(table(spark, root, "finetuned_e4b_ep2_test"), "ref", "pred")


# ---- metrics


@query(f"with {_PAIRS}, {_GRAMS} select n, matches, total from counts")
def bleu_counts(spark: SparkSession, root: str) -> DataFrame:
    return metrics.bleu_counts(_pairs(spark, root))


@query(f"with {_PAIRS}, {_GRAMS}, {_BLEU} select round(bleu, 6) as bleu from bleu")
def bleu_score(spark: SparkSession, root: str) -> DataFrame:
    return metrics.bleu(_pairs(spark, root)).select(F.round("bleu", 6).alias("bleu"))


@query(f"with recursive {_PAIRS}, {_LCS} select common, ref_len, hyp_len, round(f1, 6) as f1, count(*)::bigint as n from rouge group by all")
def rouge_l_rows(spark: SparkSession, root: str) -> DataFrame:
    rows = _pairs(spark, root).select(
        arrays.longest_common(F.col("ref"), F.col("hyp")).cast("bigint").alias("common"), F.size("ref").cast("bigint").alias("ref_len"), F.size("hyp").cast("bigint").alias("hyp_len"),
        F.round(metrics.rouge_l_of(F.col("ref"), F.col("hyp")), 6).alias("f1"),
    )
    return rows.groupBy("common", "ref_len", "hyp_len", "f1").agg(F.count(F.lit(1)).alias("n"))


@query(f"with recursive {_PAIRS}, {_LCS} select round(avg(f1) * 100, 6) as rouge_l from rouge")
def rouge_l(spark: SparkSession, root: str) -> DataFrame:
    return metrics.rouge_l(_pairs(spark, root)).select(F.round("rouge_l", 6).alias("rouge_l"))


@query(f"with {_PAIRS} select round(avg((ref = hyp)::int) * 100, 6) as exact_match from pairs")
def exact_match(spark: SparkSession, root: str) -> DataFrame:
    return metrics.exact_match(_pairs(spark, root)).select(F.round("exact_match", 6).alias("exact_match"))


_VOCAB = "hyps as (select unnest(hyp) as token from pairs)"


@query(f"with {_PAIRS}, {_VOCAB} select (count(*) filter (token in (select surface from gloss_master)))::bigint as known, count(*)::bigint as total, round((count(*) filter (token in (select surface from gloss_master)))::double / count(*) * 100, 6) as in_vocab from hyps")
def in_vocab_rate(spark: SparkSession, root: str) -> DataFrame:
    return metrics.in_vocab(_pairs(spark, root), table(spark, root, "gloss_master"), "surface").withColumn("in_vocab", F.round("in_vocab", 6))


def _union_names(spark: SparkSession, root: str) -> DataFrame:
    entries = table(spark, root, "gloss_master")
    return entries.select("surface").union(entries.select(F.explode("aliases"))).distinct()


@query(f"""with {_PAIRS}, {_VOCAB}, u as (select surface from gloss_master union select unnest(aliases) from gloss_master)
select 'own' as vocabulary, (count(*) filter (token in (select surface from gloss_master where list_contains(sources, 'own'))))::bigint as known, count(*)::bigint as total from hyps
union all select 'union', (count(*) filter (token in (select surface from u)))::bigint, count(*)::bigint from hyps""")
def in_vocab_dual(spark: SparkSession, root: str) -> DataFrame:
    own = table(spark, root, "gloss_master").filter(F.array_contains("sources", "own"))
    rates = [metrics.in_vocab(_pairs(spark, root), names, "surface").select(F.lit(v).alias("vocabulary"), "known", "total") for v, names in (("own", own), ("union", _union_names(spark, root)))]
    return rates[0].unionByName(rates[1])


@query(f"""with recursive {_PAIRS}, {_GRAMS}, {_BLEU}, {_LCS}, {_VOCAB}
select 'n' as metric, count(*)::double as value from pairs union all select 'BLEU-4', round(bleu, 2) from bleu union all select 'ROUGE-L', round(avg(f1) * 100, 2) from rouge
union all select 'ExactMatch%', round(avg((ref = hyp)::int) * 100, 2) from pairs union all select 'InVocab%', round((count(*) filter (token in (select surface from gloss_master)))::double / count(*) * 100, 2) from hyps""")
def evaluate_summary(spark: SparkSession, root: str) -> DataFrame:
    return metrics.evaluate(table(spark, root, "finetuned_e4b_ep2_test"), "ref", "pred", table(spark, root, "gloss_master"), "surface")


def _marker_sql() -> str:
    one = "select '{g}' as \"group\", len(gloss) as size, list_max(list_filter(list_transform(gloss, lambda t, i: case when {hit} then i - 1 end), lambda x: x is not null)) as spot from scrape_tslcorpus_full where len(gloss) >= 2"
    parts = [one.format(g=g, hit=" or ".join(f"contains(t, '{m}')" for m in ms)) for g, ms in MARKERS.items()]
    return f"""with hits as ({' union all '.join(parts)}), places as (select "group", spot / (size - 1)::double as place from hits where spot is not null)
select "group", count(*)::bigint as n, (count(*) filter (place <= 0.34))::bigint as early, (count(*) filter (place > 0.34 and place < 0.67))::bigint as mid, (count(*) filter (place >= 0.67))::bigint as late from places group by "group\""""


@query(_marker_sql())
def marker_position(spark: SparkSession, root: str) -> DataFrame:
    return metrics.marker_positions(table(spark, root, "scrape_tslcorpus_full"), "gloss", MARKERS)


# ---- text functions


@query(f"select id, array_to_string({_tokens('gloss_text')}, '|') as tokens, len({_tokens('gloss_text')})::bigint as n from tsl_sentences where gloss_text is not null")
def tokenize_filter(spark: SparkSession, root: str) -> DataFrame:
    own = table(spark, root, "tsl_sentences").filter("gloss_text is not null").select("id", text.tokens("gloss_text").alias("t"))
    return own.select("id", F.array_join("t", "|").alias("tokens"), F.size("t").cast("bigint").alias("n"))


@query(f"select doc_id, len(list_filter(regexp_split_to_array(translate(text, '。，？?', '    '), '[{_WS}]+'), lambda t: t <> ''))::bigint as words from documents where text is not null")
def mark_split(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").filter("text is not null").select("doc_id", F.size(text.words_between_marks("text")).cast("bigint").alias("words"))


def _parse_sql() -> str:
    def strip(x: str, chars: str = _WS) -> str:
        return f"regexp_replace({x}, '^[{chars}]+|[{chars}]+$', '', 'g')"

    line = strip(strip(strip("x"), "`"))
    line = f"regexp_replace({line}, '^(?:{text.LABELS})[：:][{_WS}]*', '')"
    line = strip(f"replace(translate({line}, '／', '/'), ' ', '')", text.QUOTES.replace("'", "''"))
    line = f"regexp_replace({line}, '{text.END_NOTE}', '')"
    line = f"regexp_replace({line}, '[{text.END_MARKS}]+$', '')"
    return f"""with lines as (select _ord, list_filter(list_transform(regexp_split_to_array({strip('raw')}, '{_BREAK}'), lambda x: {line}), lambda x: x <> '') as l from finetuned_e4b_ep2_test)
select _ord, coalesce(list_filter(l, lambda x: contains(x, '/'))[1], l[-1], '') as pred from lines"""


@query(_parse_sql())
def parse_prediction(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "finetuned_e4b_ep2_test").select("_ord", text.parse_prediction("raw").alias("pred"))


@query(f"""select line_id, case when json_valid(line) and json_type(line, '$.nms') = 'ARRAY' then array_to_string(from_json(json_extract(line, '$.nms'), '["VARCHAR"]'), '|')
when json_valid(line) and json_type(line, '$.nms') = 'VARCHAR' then array_to_string(list_filter(regexp_split_to_array(translate(json_extract_string(line, '$.nms'), '／/', '  '), '[{_WS}]+'), lambda t: t <> ''), '|') else '' end as nms from sentence_lines""")
def json_union_field(spark: SparkSession, root: str) -> DataFrame:
    field = F.expr("to_json(try_variant_get(try_parse_json(line), '$.nms', 'variant'))")
    return table(spark, root, "sentence_lines").select("line_id", F.array_join(text.list_or_words(field), "|").alias("nms"))


@query("""with v as (select id, unnest(gloss) as name from tsl_sentences) select id, name, regexp_extract(name, '^(.+?)_([A-Za-z]{1,2}\\d?)$', 1) as base, regexp_extract(name, '^(.+?)_([A-Za-z]{1,2}\\d?)$', 2) as variant, count(*)::bigint as n
from v where regexp_matches(name, '^(.+?)_([A-Za-z]{1,2}\\d?)$') group by all""")
def variant_names(spark: SparkSession, root: str) -> DataFrame:
    names = table(spark, root, "tsl_sentences").select("id", F.explode("gloss").alias("name"))
    split_names = names.select("id", "name", text.base_name("name").alias("base"), text.variant_of("name").alias("variant")).filter("variant is not null")
    return split_names.groupBy("id", "name", "base", "variant").agg(F.count(F.lit(1)).alias("n"))


@query("select id, list_transform(list_filter([theme, speaker, review_status], lambda v: v is not null and v <> ''), lambda x: x) as present from scrape_tslcorpus_full group by all")
def pivot_present(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "scrape_tslcorpus_full").select("id", arrays.non_empty(F.col("theme"), F.col("speaker"), F.col("review_status")).alias("present")).distinct()


@query("""with o as (select line_id, from_json(case when json_valid(line) and json_type(line) = 'OBJECT' then line end, '{"source_file":"VARCHAR"}').source_file as f from sentence_lines) select line_id, case when f is null or f = '' then [] else [f] end as found from o""")
def dynamic_keys(spark: SparkSession, root: str) -> DataFrame:
    fields = F.from_json("line", "map<string,string>")
    found = F.coalesce(arrays.values_of_keys(fields, "so", "_fi"), F.array().cast("array<string>"))
    return table(spark, root, "sentence_lines").select("line_id", found.alias("found"))


@query("select surface, case when len(aliases) = 0 then 'null' when len(aliases) = 1 then to_json(aliases[1])::varchar else to_json(aliases)::varchar end as aliases from gloss_master")
def scalar_or_list(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "gloss_master").select("surface", text.scalar_or_list("aliases").alias("aliases"))


# ---- vocabulary


@query("select g as gloss, count(*)::bigint as freq from (select unnest(gloss) as g from scrape_tslcorpus_full) where g is not null group by g")
def token_freq(spark: SparkSession, root: str) -> DataFrame:
    return vocabulary.frequencies(table(spark, root, "scrape_tslcorpus_full"), "gloss")


@query("with p as (select unnest(gloss) as gloss, id, _ord as o from tsl_sentences where source = 'real') select gloss, id, min(o) as first from p where gloss is not null and not contains(gloss, '＿') group by gloss, id")
def inverted_index(spark: SparkSession, root: str) -> DataFrame:
    return vocabulary.postings(table(spark, root, "tsl_sentences").filter("source = 'real'"), "id", "gloss", "_ord")


def _master(spark: SparkSession, root: str) -> DataFrame:
    own = table(spark, root, "tsl_sentences").filter("source = 'real'").select(F.explode("gloss").alias("gloss")).filter(F.col("gloss").isNotNull() & ~F.col("gloss").contains(text.PLACEHOLDER))
    entries = table(spark, root, "gloss_master").filter(F.array_contains("sources", "twtsl")).select("surface", "aliases", F.col("twtsl_ids").alias("ids"))
    return vocabulary.master(own, entries, vocabulary.frequencies(table(spark, root, "scrape_tslcorpus_full"), "gloss"))


_MASTER = """own as (select distinct g as surface from (select unnest(gloss) as g from tsl_sentences where source = 'real') where g is not null and not contains(g, '＿')),
tw as (select surface, twtsl_ids from gloss_master where list_contains(sources, 'twtsl')), al as (select distinct unnest(aliases) as surface from gloss_master where list_contains(sources, 'twtsl')),
co as (select g as surface, count(*)::bigint as freq from (select unnest(gloss) as g from scrape_tslcorpus_full) where g is not null group by g),
k as (select surface from own union select surface from tw union select surface from al union select surface from co),
flags as (select surface, surface in (select surface from own) as o, surface in (select surface from tw) as t, surface in (select surface from al) as a, surface in (select surface from co) as c, translate(surface, '臺着菸祐', '台著煙佑') as norm from k),
listed as (select surface, list_filter([case when o then 'own' end, case when t then 'twtsl' when a then 'twtsl-alias' end, case when c then 'corpus' end], lambda x: x is not null) as sources,
  coalesce((select any_value(freq) from co where co.surface = flags.surface), 0)::bigint as corpus_freq, (o or t or a) as has_dict_entry, max(o or t or a) over (partition by norm) as norm_has_dict_entry,
  coalesce((select any_value(list_sort(list_distinct(twtsl_ids))) from tw where tw.surface = flags.surface), []) as twtsl_ids from flags)"""


@query(f"with {_MASTER} select surface, sources, corpus_freq, has_dict_entry, norm_has_dict_entry, twtsl_ids from listed")
def vocab_master(spark: SparkSession, root: str) -> DataFrame:
    return _master(spark, root)


@query(f"""with {_MASTER}, one as (select (count(*) filter (list_contains(sources, 'own')))::bigint as own_gloss, (count(*) filter (list_contains(sources, 'twtsl')))::bigint as twtsl_canonical, (count(*) filter (list_contains(sources, 'corpus')))::bigint as corpus_unique_gloss, sum(corpus_freq)::bigint as corpus_token_total, count(*)::bigint as master_total_surface,
(count(*) filter (list_contains(sources, 'corpus') and has_dict_entry))::bigint as corpus_type_in_dict_raw, (count(*) filter (list_contains(sources, 'corpus') and norm_has_dict_entry))::bigint as corpus_type_in_dict_norm, (sum(corpus_freq) filter (norm_has_dict_entry))::bigint as corpus_token_in_dict_norm from listed)
select *, round(corpus_type_in_dict_raw::double / corpus_unique_gloss * 100, 1) as corpus_type_in_dict_raw_pct, round(corpus_type_in_dict_norm::double / corpus_unique_gloss * 100, 1) as corpus_type_in_dict_norm_pct, round(corpus_token_in_dict_norm::double / corpus_token_total * 100, 1) as corpus_token_in_dict_norm_pct from one""")
def vocab_coverage(spark: SparkSession, root: str) -> DataFrame:
    return vocabulary.coverage(_master(spark, root))


@query("select surface from gloss_master union select unnest(aliases) from gloss_master")
def vocab_union(spark: SparkSession, root: str) -> DataFrame:
    return _union_names(spark, root)


@query("select gloss_id, list_sort(list_distinct(list_filter(list_transform(aliases, lambda a: translate(regexp_replace(a, '^(.+?)_([A-Za-z]{1,2}\\d?)$', '\\1'), '臺着菸祐', '台著煙佑')), lambda a: a <> surface))) as aliases from gloss_master")
def alias_join(spark: SparkSession, root: str) -> DataFrame:
    return vocabulary.alias_names(table(spark, root, "gloss_master"), "gloss_id", "surface", "aliases")


@query("select flag, count(*)::bigint as n from (select unnest(case when nms is null or len(nms) = 0 then ['none'] else nms end) as flag from tsl_sentences) group by flag")
def flag_rollup(spark: SparkSession, root: str) -> DataFrame:
    return vocabulary.flag_rollup(table(spark, root, "tsl_sentences"), "nms")


@query("with s as (select id, unnest(gloss) as token, generate_subscripts(gloss, 1) - 1 as pos from tsl_sentences) select id, pos::int as pos, token from s where token is not null and token not in (select surface from gloss_master)")
def external_tokens(spark: SparkSession, root: str) -> DataFrame:
    return joins.unexpected_tokens(table(spark, root, "tsl_sentences"), "id", "gloss", table(spark, root, "gloss_master"), "surface").filter("token is not null")


@query("""with a as (select g as gloss from (select unnest(gloss) as g from tsl_sentences) where g is not null), b as (select g as gloss from (select unnest(gloss) as g from scrape_tslcorpus_full) where g is not null)
select gloss, gloss in (select gloss from a) as in_sentences, gloss in (select gloss from b) as in_corpus from (select gloss from a union select gloss from b)""")
def gloss_membership(spark: SparkSession, root: str) -> DataFrame:
    parts = [(n, vocabulary.frequencies(table(spark, root, t), "gloss")) for n, t in (("sentences", "tsl_sentences"), ("corpus", "scrape_tslcorpus_full"))]
    return joins.flagged_membership(parts, "gloss")


# ---- order


@query("select id, corpus_id, chinese, gloss_text, _ord from (select *, row_number() over (partition by chinese, gloss_text order by _ord) as rn from scrape_tslcorpus_full) where rn = 1")
def dedup_keep_first(spark: SparkSession, root: str) -> DataFrame:
    own = table(spark, root, "scrape_tslcorpus_full").select("id", "corpus_id", "chinese", "gloss_text", "_ord")
    return order.keep_first(own, ["chinese", "gloss_text"], "_ord")


@query("select id, pred, _ord from (select *, row_number() over (partition by id order by _ord desc) as rn from finetuned_e4b_ep2_test) where rn = 1")
def keep_last(spark: SparkSession, root: str) -> DataFrame:
    return order.keep_first(table(spark, root, "finetuned_e4b_ep2_test").select("id", "pred", "_ord"), ["id"], "_ord", last=True)


_BLOCKS = "b as (select *, sum((film_url is not null)::int) over (order by _ord) as block from scrape_tslcorpus_full)"


@query(f"with {_BLOCKS} select _ord, id, block::bigint as block from b where block > 0")
def block_fill(spark: SparkSession, root: str) -> DataFrame:
    own = table(spark, root, "scrape_tslcorpus_full").select("_ord", "id", "film_url")
    return order.blocks(own, F.col("film_url").isNotNull(), "_ord").select("_ord", "id", "block")


@query(f"""with {_BLOCKS}, m as (select corpus_id, arg_min(chinese, _ord) as chinese, arg_min(gloss_text, _ord) as gloss_text, count(distinct block)::bigint as n_videos, list_sort(list_distinct(flatten(list([theme]) filter (theme is not null)))) as marks from b where block > 0 group by corpus_id)
select corpus_id, chinese, gloss_text, n_videos, coalesce(marks, []) as marks from m""")
def block_merge(spark: SparkSession, root: str) -> DataFrame:
    own = table(spark, root, "scrape_tslcorpus_full").select("_ord", "corpus_id", "chinese", "gloss_text", "film_url", F.array_compact(F.array("theme")).alias("marks"))
    return corpus.merge_blocks(order.blocks(own, F.col("film_url").isNotNull(), "_ord"), "block", "corpus_id", "_ord", "chinese", "gloss_text", "marks")


@query("select chinese, count(distinct gloss_text)::bigint as glosses from tsl_sentences group by chinese having count(distinct gloss_text) > 1")
def consistency_violations(spark: SparkSession, root: str) -> DataFrame:
    return corpus.inconsistent(table(spark, root, "tsl_sentences"), "chinese", "gloss_text")


@query("select _ord, id, format('TC{:05d}', row_number() over (order by _ord)) as number from split_data")
def sequential_ids(spark: SparkSession, root: str) -> DataFrame:
    own = table(spark, root, "split_data").select("_ord", "id")
    return order.sequential_ids(own, "_ord", "number", "TC", 5)


@query("select id, chinese from tsl_sentences where not coalesce(is_template, false) order by _ord limit 20")
def head_n(spark: SparkSession, root: str) -> DataFrame:
    return order.head(table(spark, root, "tsl_sentences").filter("not coalesce(is_template, false)"), "_ord", 20).select("id", "chinese")


@query("select id from scrape_tslcorpus_full order by md5('7:' || id), id limit 50")
def word_sample(spark: SparkSession, root: str) -> DataFrame:
    return order.hashed_sample(table(spark, root, "scrape_tslcorpus_full").select("id"), 50, 7, "id")


@query("select source, coalesce(max(try_cast(substr(id, 4) as bigint)), 0) as last from split_data group by source")
def last_number(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "split_data").groupBy("source").agg(F.coalesce(F.max(text.id_number("id", 3)), F.lit(0)).alias("last"))


# ---- joins


@query("select p._ord, p.id from split_data p where p.chinese not in (select chinese from tsl_sentences where split = 'test' and chinese is not null) and p.gloss_text not in (select gloss_text from tsl_sentences where split = 'test' and gloss_text is not null) or p.chinese is null and coalesce(p.gloss_text, '') not in (select gloss_text from tsl_sentences where split = 'test' and gloss_text is not null) or p.gloss_text is null and p.chinese not in (select chinese from tsl_sentences where split = 'test' and chinese is not null)")
def leak_filter_or(spark: SparkSession, root: str) -> DataFrame:
    test = table(spark, root, "tsl_sentences").filter("split = 'test'")
    return joins.not_in_any(table(spark, root, "split_data"), test, ["chinese", "gloss_text"]).select("_ord", "id")


@query("select id from tsl_sentences where split = 'test' and id not in (select id from finetuned_e4b_ep2_test)")
def resume_todo(spark: SparkSession, root: str) -> DataFrame:
    return joins.resume(table(spark, root, "tsl_sentences").filter("split = 'test'").select("id"), table(spark, root, "finetuned_e4b_ep2_test"), "id")


@query("select d.id, d.chinese, coalesce(n.status, d.review_status) as review_status from split_data d left join (select id, any_value(speaker) as status from scrape_tslcorpus_full group by id) n using (id)")
def sheet_update(spark: SparkSession, root: str) -> DataFrame:
    news = table(spark, root, "scrape_tslcorpus_full").groupBy("id").agg(F.max("speaker").alias("review_status"))
    return joins.updated(table(spark, root, "split_data").select("id", "chinese", "review_status"), news, "id", ["review_status"])


@query(f"select id, {' '.join(['case', *[f'''when contains(chinese, '{k}') then '{t}' ''' for _, t, k in KEYWORDS], 'end'])} as hit_theme, {' '.join(['case', *[f'''when contains(chinese, '{k}') then '{k}' ''' for _, _, k in KEYWORDS], 'end'])} as keyword, _ord from scrape_tslcorpus_full where {' or '.join(f'''contains(chinese, '{k}')''' for _, _, k in KEYWORDS)}")
def theme_keyword_first_hit(spark: SparkSession, root: str) -> DataFrame:
    own = table(spark, root, "scrape_tslcorpus_full").select("id", "chinese", "_ord")
    return joins.first_keyword(own, "chinese", dimension(spark, KEYWORDS, "ord int, theme string, keyword string")).drop("chinese")


# ---- split

_RECORDS = """records as (select d._ord, d.id, d.chinese, d.gloss_text, d.source, case when d.source = 'tslcorpus' then 'corpus:' || regexp_replace(coalesce(nullif(s.seg_uuid, ''), nullif(s.corpus, ''), d.id), 'P\\d+$', '') else d.source || ':' || coalesce(nullif(d.group_key, ''), d.id) end as grp, d.confidence, coalesce(d.review_status, 'n/a') as review_status
from split_data d left join (select id, arg_min(seg_uuid, _ord) filter (rn = 1) as seg_uuid, split_part(arg_min(corpus_id, _ord), '/', 1) as corpus from (select *, row_number() over (partition by id order by _ord) as rn from scrape_tslcorpus_full) where rn = 1 group by id) s using (id))"""


def _records(spark: SparkSession, root: str) -> DataFrame:
    segments = order.keep_first(table(spark, root, "scrape_tslcorpus_full").select("id", "_ord", "seg_uuid", "corpus_id"), ["id"], "_ord").drop("_ord")
    rows = table(spark, root, "split_data").join(segments, "id", "left")
    talk = text.group_key("source", "id", "seg_uuid", "corpus_id", F.lit(None).cast("string"), F.lit(None).cast("string"))
    group = F.when(F.col("source") == "tslcorpus", talk).otherwise(F.concat("source", F.lit(":"), text.first_true("group_key", "id")))
    return split.record(rows, group)


@query(f"with {_RECORDS} select _ord, id, source, grp as \"group\", confidence, review_status from records")
def unified_pool(spark: SparkSession, root: str) -> DataFrame:
    return _records(spark, root).select("_ord", "id", "source", "group", "confidence", "review_status")


@query("select source, count(*)::bigint as rows, (count(*) filter (len(string_split(gloss_text, '/')) >= 2))::bigint as kept, (count(*) filter (len(string_split(gloss_text, '/')) < 2))::bigint as dropped from split_data where gloss_text is not null group by source")
def min_len_filter_counts(spark: SparkSession, root: str) -> DataFrame:
    size = F.size(F.split("gloss_text", "/"))
    return table(spark, root, "split_data").filter("gloss_text is not null").groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.count_if(size >= 2).alias("kept"), F.count_if(size < 2).alias("dropped"))


@query("select id from split_data where confidence is distinct from 'rule-derived'")
def exclude_class_nullsafe(spark: SparkSession, root: str) -> DataFrame:
    return split.without_class(table(spark, root, "split_data"), "confidence", "rule-derived").select("id")


@query("select split, source, sum(greatest(len(gloss) - 3, 0))::bigint as four_grams from tsl_sentences where gloss is not null group by all")
def ngram4_count(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "tsl_sentences").filter("gloss is not null").groupBy("split", "source").agg(F.sum(F.greatest(F.size("gloss") - 3, F.lit(0))).alias("four_grams"))


def _holdout_sql(rows: str, ratio: float, seed: int, stratum: str, least: int) -> str:
    return f"""sizes as (select {stratum} as stratum, grp, count(*)::bigint as size from {rows} group by all), totals as (select stratum, sum(size) as n from sizes group by stratum),
ranked as (select s.stratum, s.grp, s.size, case when n < {least} then 0 else round_even(n * {ratio}::double, 0) end as target, coalesce(sum(size) over (partition by s.stratum order by md5('{seed}:' || s.stratum || s.grp) || '/' || s.grp rows between unbounded preceding and 1 preceding), 0) as before from sizes s join totals using (stratum)),
held as (select stratum, grp, size from ranked where before < target)"""


@query(f"with {_RECORDS}, {_holdout_sql('records', 0.08, 42, 'source', 10)} select stratum, grp as \"group\", size from held")
def holdout_split(spark: SparkSession, root: str) -> DataFrame:
    return order.greedy_holdout(_records(spark, root), "group", 0.08, 42, "source", 10)


_TEST = "test as (select chinese, gloss_text from tsl_sentences where split = 'test' and not coalesce(is_template, false))"
_SPLIT = f"""{_RECORDS}, {_TEST},
pool as (select * from records where chinese <> '' and gloss_text <> '' and not contains(gloss_text, '＿') and confidence is distinct from 'rule-derived' and (source <> 'tslcorpus' or len(string_split(gloss_text, '/')) >= 2)),
c as (select * from pool where source = 'tslcorpus'),
csizes as (select grp, count(*)::bigint as size from c group by grp),
cranked as (select grp, size, round_even((select count(*) from c) * 0.12::double, 0) as target, coalesce(sum(size) over (order by md5('42:' || grp) || '/' || grp rows between unbounded preceding and 1 preceding), 0) as before from csizes),
cheld as (select grp from cranked where before < target),
ccand as (select * from c where grp in (select grp from cheld) and chinese not in (select chinese from test where chinese is not null) and gloss_text not in (select gloss_text from test where gloss_text is not null)),
tc as (select * from (select *, row_number() over (partition by chinese, gloss_text order by _ord) as rn from ccand) where rn = 1),
seen as (select chinese, gloss_text from test union all select chinese, gloss_text from tc),
rest as (select * from (select *, row_number() over (partition by chinese, gloss_text order by _ord) as rn from pool where grp not in (select grp from cheld) and chinese not in (select chinese from seen where chinese is not null) and gloss_text not in (select gloss_text from seen where gloss_text is not null)) where rn = 1),
{_holdout_sql('rest', 0.08, 42, 'source', 10)},
placed as (select r.*, case when h.grp is not null then 'dev' else 'train' end as split from rest r left join held h on r.source = h.stratum and r.grp = h.grp union all select *, 'test_corpus' as split from tc)"""


def _placed(spark: SparkSession, root: str) -> DataFrame:
    test = table(spark, root, "tsl_sentences").filter("split = 'test' and not coalesce(is_template, false)")
    core = test.select("_ord", "id", "chinese", "gloss_text", F.lit("core-test").alias("source"), F.concat(F.lit("test:"), "id").alias("group"), F.lit(None).cast("string").alias("confidence"), F.lit("n/a").alias("review_status"))
    return split.split(_records(spark, root), core)


@query(f"with {_SPLIT} select id, split from placed")
def leakage_safe_split(spark: SparkSession, root: str) -> DataFrame:
    return _placed(spark, root).filter("split <> 'test'").select("id", "split")


@query(f"with {_SPLIT} select split, source, count(*)::bigint as rows, count(distinct grp)::bigint as groups, sum(greatest(len(string_split(gloss_text, '/')) - 3, 0))::bigint as four_grams from placed group by split, source")
def split_manifest(spark: SparkSession, root: str) -> DataFrame:
    return split.manifest(_placed(spark, root).filter("split <> 'test'"))


@query(f"""with {_SPLIT} select 'train/dev' as pair, (select count(*) from (select grp from placed where split = 'train' intersect select grp from placed where split = 'dev'))::bigint as shared
union all select 'test_corpus/pool', (select count(*) from (select grp from placed where split = 'test_corpus' intersect select grp from placed where split in ('train', 'dev')))::bigint""")
def group_leak_check(spark: SparkSession, root: str) -> DataFrame:
    return split.leaks(_placed(spark, root))


# ---- corpus and templates


@query(f"""with own as (select _ord, corpus_id, chinese, list_filter(list_transform(gloss, lambda t: regexp_replace(t, '[{text.TOKEN_MARKS}{_WS}]+', '', 'g')), lambda t: t <> '') as gloss, case when film_url like '/%' then 'https://corpus.example' || film_url else film_url end as film_url from scrape_tslcorpus_full),
kept as (select *, row_number() over (partition by corpus_id order by _ord) as rn from own where chinese <> '' and len(gloss) > 0)
select format('TC{{:09d}}', row_number() over (order by _ord)) as id, corpus_id, chinese, array_to_string(gloss, '/') as gloss_text, film_url from kept where rn = 1""")
def corpus_consolidate(spark: SparkSession, root: str) -> DataFrame:
    return corpus.consolidate(table(spark, root, "scrape_tslcorpus_full"), "https://corpus.example")


def _expanded(spark: SparkSession, root: str) -> DataFrame:
    templates = dimension(spark, TEMPLATES, "ord int, tid string, phrasings array<string>, gloss array<string>, slots array<string>, times array<string>")
    return corpus.expand_templates(templates, table(spark, root, "tsl_sentences"))


_TEMPLATE = """t as (select 1 as ord, 'T1' as tid, ['{P}在{T}嗎？', '{T}有{P}嗎？'] as phrasings, ['{T}', '{P}', '有'] as gloss, ['湯匙', '外套', '腳踏車'] as slots, ['今天', '明天'] as times
union all select 2, 'T2', ['我想買{P}。'], ['我', '{P}', '買', '想'], ['書包', '手機'], [null] union all select 3, 'T3', ['沒有。'], ['沒有'], [null], [null]),
e as (select ord, tid, p, gloss, tm, pi, ti, unnest(phrasings) as phrase, generate_subscripts(phrasings, 1) as fi from (select *, unnest(times) as tm, generate_subscripts(times, 1) as ti from (select *, unnest(slots) as p, generate_subscripts(slots, 1) as pi from t))),
x as (select ord, pi, ti, fi, tid, replace(replace(phrase, '{P}', coalesce(p, '')), '{T}', coalesce(tm, '')) as chinese, array_to_string(list_filter(list_transform(gloss, lambda g: replace(replace(g, '{P}', coalesce(p, '')), '{T}', coalesce(tm, ''))), lambda g: g <> ''), '/') as gloss_text from e),
f as (select *, row_number() over (partition by chinese, gloss_text order by ord, pi, ti, fi) as rn from x where chinese not in (select chinese from tsl_sentences where chinese is not null))"""


@query(f"with {_TEMPLATE} select tid, chinese, gloss_text from f where rn = 1")
def template_expand(spark: SparkSession, root: str) -> DataFrame:
    return _expanded(spark, root).drop("place")


@query(f"""with {_TEMPLATE}, old as (select id, chinese, gloss_text, 'old' as batch from split_data where source = 'synth'), l as (select coalesce(max(try_cast(substr(id, 4) as bigint)), 0) as last from old)
select id, chinese, gloss_text, batch from old union all select format('SYN{{:09d}}', last + row_number() over (order by ord, pi, ti, fi)), chinese, gloss_text, 'new' from f, l where rn = 1 and (chinese, gloss_text) not in (select (chinese, gloss_text) from old where chinese is not null and gloss_text is not null)""")
def template_expand_incremental(spark: SparkSession, root: str) -> DataFrame:
    old = table(spark, root, "split_data").filter("source = 'synth'").withColumn("batch", F.lit("old"))
    return corpus.merge_synthetic(old, _expanded(spark, root), "new", width=9)


# ---- prompts and training rows

_POOL = [("S000000001", "你要喝水嗎？", "你/喝/水/要"), ("S000000002", "他沒有來。", "他/來/沒有"), ("X1", "今天很冷。", "今天/冷")]


@query("""select id, concat_ws('

', '把句子譯成手語詞序。', array_to_string(list_filter([case when id <> 'S000000001' then '中文：你要喝水嗎？
Gloss：你/喝/水/要' end, case when id <> 'S000000002' then '中文：他沒有來。
Gloss：他/來/沒有' end, '中文：今天很冷。
Gloss：今天/冷'], lambda x: x is not null), chr(10)), '中文：' || chinese || '
Gloss：') as prompt from tsl_sentences where chinese is not null""")
def fewshot_prompts(spark: SparkSession, root: str) -> DataFrame:
    own = table(spark, root, "tsl_sentences").filter("chinese is not null")
    return own.select("id", prompts.prompt("把句子譯成手語詞序。", F.col("chinese"), examples=prompts.exemplars(_POOL, F.col("id"))).alias("prompt"))


# The limit of a training row in the reference.
MAX_LEN = 512


def _codes(column: str):
    return F.transform(F.split(F.coalesce(column, F.lit("")), ""), lambda c: F.ascii(c))


_MASKED = """with c as (select _ord, list_transform(string_split(coalesce(chinese, ''), ''), lambda x: unicode(x)) as p, list_transform(string_split(coalesce(chinese, '') || coalesce(ref, ''), ''), lambda x: unicode(x)) as w from finetuned_e4b_ep2_test where chinese <> '' and ref <> '')
select _ord, list_concat(list_transform(range(0, len(p)), lambda i: -100), w[len(p) + 1 :])[1:512] as labels from c"""


@query(_MASKED)
def mask_labels(spark: SparkSession, root: str) -> DataFrame:
    return mask_labels_512(spark, root)


@query(_MASKED)
def mask_labels_512(spark: SparkSession, root: str) -> DataFrame:
    own = table(spark, root, "finetuned_e4b_ep2_test").filter("chinese <> '' and ref <> ''")
    return own.select("_ord", arrays.masked_labels(_codes("chinese"), F.transform(F.split(F.concat("chinese", "ref"), ""), lambda c: F.ascii(c)), MAX_LEN).alias("labels"))


@query("""with c as (select _ord, _ord // 8 as batch, list_transform(string_split(chinese, ''), lambda x: unicode(x)) as ids from finetuned_e4b_ep2_test where chinese <> ''), m as (select *, max(len(ids)) over (partition by batch) as longest from c)
select _ord, list_concat(ids, list_transform(range(0, longest - len(ids)), lambda i: 0)) as ids, list_concat(list_transform(ids, lambda i: 1), list_transform(range(0, longest - len(ids)), lambda i: 0)) as mask from m""")
def pad_batch(spark: SparkSession, root: str) -> DataFrame:
    own = table(spark, root, "finetuned_e4b_ep2_test").filter("chinese <> ''").select("_ord", F.floor(F.col("_ord") / 8).alias("batch"), _codes("chinese").alias("ids"))
    from pyspark.sql.window import Window

    longest = own.withColumn("longest", F.max(F.size("ids")).over(Window.partitionBy("batch")))
    return longest.select("_ord", arrays.padded(F.col("ids"), F.col("longest"), 0).alias("ids"), arrays.padded(F.transform("ids", lambda _: F.lit(1)), F.col("longest"), 0).alias("mask"))


@query("select id, array_to_string(string_split(coalesce(chinese, ''), ''), '/') as raw from finetuned_e4b_ep2_test")
def infer_stub(spark: SparkSession, root: str) -> DataFrame:
    def client() -> Callable[[list[str]], list[str]]:
        return lambda texts: ["/".join(t) for t in texts]

    return prompts.infer(table(spark, root, "finetuned_e4b_ep2_test"), "id", "chinese", client)


@query("""with s as (select source as system, 'rows' as metric, count(*)::bigint as value from split_data group by source), n as (select source as system, 'rows' as metric, count(*)::bigint as value from tsl_sentences group by source)
select * from n union all select * from s where system not in (select system from n where system is not null)""")
def summary_upsert(spark: SparkSession, root: str) -> DataFrame:
    count = lambda t: table(spark, root, t).groupBy(F.col("source").alias("system"), F.lit("rows").alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    return sinks.upsert(count("split_data"), count("tsl_sentences"), ["system", "metric"])


@query("""with n as (select unnest(twtsl_ids) as id, surface, gloss_id from gloss_master), f as (select id, surface, min(gloss_id) as spot from n group by id, surface)
select id, list(surface order by spot, surface) as names from f group by id""")
def ordered_names(spark: SparkSession, root: str) -> DataFrame:
    names = table(spark, root, "gloss_master").select(F.explode("twtsl_ids").alias("id"), "surface", "gloss_id")
    return vocabulary.ordered_names(names, "id", "surface", "gloss_id")


_RULES = """rules as (select id, gloss, case when array_position(gloss, '沒有') >= len(gloss) - 1 then 'late negation' when gloss[1] in ('今天', '昨天', '明天') then 'early time' else 'order open' end as said,
list_filter([case when gloss[-1] = '要' then 'modal last' end, case when len(coalesce(nms, [])) > 0 then 'marks' end, case when list_contains(gloss, '說') then 'speech' end], lambda x: x is not null) as found from tsl_sentences where gloss is not null and len(gloss) > 0)"""


def _reviewed(spark: SparkSession, root: str) -> DataFrame:
    own = table(spark, root, "tsl_sentences").filter("gloss is not null and size(gloss) > 0")
    last, first = F.element_at("gloss", -1), F.element_at("gloss", 1)
    said = checks.verdict([(F.array_position("gloss", "沒有") >= F.size("gloss") - 1, "late negation"), (first.isin("今天", "昨天", "明天"), "early time")], "order open")
    more = checks.notes([(last == "要", "modal last"), (F.size(F.coalesce("nms", F.array().cast("array<string>"))) > 0, "marks"), (F.array_contains("gloss", "說"), "speech")], "checked")
    return own.select("id", said.alias("said"), more.alias("note"))


@query(f"with {_RULES} select id, said, array_to_string(list_concat(['checked'], found), '；') as note from rules")
def review_verdicts(spark: SparkSession, root: str) -> DataFrame:
    return _reviewed(spark, root)


@query(f"with {_RULES}, b as (select case when contains(array_to_string(list_concat(['checked'], found), '；'), 'speech') then 'native' when contains(said, 'open') then 'confirm' else 'acceptable' end as bucket from rules) select bucket, count(*)::bigint as n from b group by bucket")
def review_buckets(spark: SparkSession, root: str) -> DataFrame:
    both = F.concat_ws("；", "said", "note")
    return _reviewed(spark, root).select(checks.bucket(both, [("speech", "native")], [("open", "confirm")], "acceptable").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("select _ord, case when ref is null then ['user'] else ['user', 'assistant'] end as roles, case when ref is null then [chinese] else [chinese, ref] end as contents from finetuned_e4b_ep2_test")
def chat_messages(spark: SparkSession, root: str) -> DataFrame:
    chat = table(spark, root, "finetuned_e4b_ep2_test").select("_ord", prompts.messages(F.col("chinese"), F.col("ref")).alias("m"))
    return chat.select("_ord", F.col("m.role").alias("roles"), F.col("m.content").alias("contents"))


@query("select count(*)::bigint as both from (select chinese from tsl_sentences where chinese is not null intersect select chinese from split_data where chinese is not null)")
def shared_texts(spark: SparkSession, root: str) -> DataFrame:
    some = lambda t: table(spark, root, t).filter("chinese is not null")
    return joins.shared_groups(some("tsl_sentences"), some("split_data"), "chinese").agg(F.count(F.lit(1)).alias("both"))


@query("select surface, translate(surface, '臺着菸祐', '台著煙佑') as norm, replace(surface, ':', '_') as tag, split_part(surface, '/', 1) as head from gloss_master")
def surface_forms(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "gloss_master").select("surface", text.norm_variants("surface").alias("norm"), text.file_tag("surface").alias("tag"), text.prefix_of("surface").alias("head"))


@query("select split, count(distinct source_file)::bigint as files, count(distinct source)::bigint as sources, (count(*) filter (len(gloss) > 0))::bigint as with_gloss from tsl_sentences group by split")
def groups_per_split(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "tsl_sentences").groupBy("split").agg(F.countDistinct("source_file").alias("files"), F.countDistinct("source").alias("sources"), F.count_if(F.size("gloss") > 0).alias("with_gloss"))


# ---- sheets: token rows to blocks, blocks to sentences

_SHEET = """tokens as (select s._ord, s.corpus_id, s.chinese, s.block, unnest(s.gloss) as token, generate_subscripts(s.gloss, 1)::int - 1 as place from (select *, sum((film_url is not null)::int) over (order by _ord) as block from scrape_tslcorpus_full) s where block > 0 and gloss is not null and len(gloss) > 0),
lists as (select block, min(_ord) as _ord, coalesce(list(token order by place, _ord) filter (token is not null), []) as glosses from tokens group by block),
named as (select l.block, l._ord, f.corpus_id, f.chinese, l.glosses from lists l join (select distinct _ord, corpus_id, chinese from tokens) f using (_ord))"""


def _sheet_blocks(spark: SparkSession, root: str) -> DataFrame:
    own = table(spark, root, "scrape_tslcorpus_full").select("_ord", "corpus_id", "chinese", "gloss", "film_url")
    tokens = joins.nested_rows(order.blocks(own, F.col("film_url").isNotNull(), "_ord"), "gloss", "token", "place")
    return corpus.block_tokens(tokens, "block", "place", "_ord", "token", "corpus_id", "chinese")


@query(f"with {_SHEET} select block::bigint as block, corpus_id, chinese, array_to_string(glosses, '/') as gloss_text, len(glosses)::bigint as n from named")
def block_tokens(spark: SparkSession, root: str) -> DataFrame:
    return _sheet_blocks(spark, root).select("block", "corpus_id", "chinese", F.array_join("glosses", "/").alias("gloss_text"), F.size("glosses").cast("bigint").alias("n"))


@query(f"with {_SHEET} select corpus_id, arg_min(chinese, _ord) as chinese, array_to_string(arg_min(glosses, _ord), '/') as gloss_text, count(distinct block)::bigint as n_videos from named group by corpus_id")
def sheet_sentences(spark: SparkSession, root: str) -> DataFrame:
    blocks = _sheet_blocks(spark, root).withColumn("marks", F.array().cast("array<string>"))
    return corpus.merge_blocks(blocks, "block", "corpus_id", "_ord", "chinese", "glosses", "marks").select("corpus_id", "chinese", F.array_join("glosses", "/").alias("gloss_text"), "n_videos")


@query(f"with {_SHEET} select corpus_id, count(distinct glosses)::bigint as glosses from named group by corpus_id having count(distinct glosses) > 1")
def block_consistency(spark: SparkSession, root: str) -> DataFrame:
    return corpus.inconsistent(_sheet_blocks(spark, root), "corpus_id", "glosses")


# ---- nested records, unions, counts


@query(f"""with r as (select line_id, case when json_valid(line) and json_type(line) = 'OBJECT' and json_type(line, '$.nms') = 'ARRAY' then from_json(json_extract(line, '$.nms'), '["VARCHAR"]') end as g from sentence_lines)
select line_id, g[1] as first, len(g)::bigint as n from r where len(g) > 0""")
def first_of_records(spark: SparkSession, root: str) -> DataFrame:
    flags = F.expr("try_variant_get(try_parse_json(line), '$.nms', 'array<string>')")
    some = table(spark, root, "sentence_lines").select("line_id", flags.alias("records")).withColumn("n", F.size("records").cast("bigint"))
    return joins.first_record(some, "records", "first").select("line_id", "first", "n")


@query("select id, chinese, place::int as place, gloss from (select id, chinese, unnest(gloss) as gloss, generate_subscripts(gloss, 1) - 1 as place from scrape_tslcorpus_full where chinese <> '')")
def nested_sentences(spark: SparkSession, root: str) -> DataFrame:
    sentence = F.struct("chinese", "gloss")
    segments = table(spark, root, "scrape_tslcorpus_full").select("id", F.when(F.col("chinese") != "", F.array(sentence)).otherwise(F.array().cast("array<struct<chinese:string,gloss:array<string>>>")).alias("apiData"))
    rows = joins.nested_rows(segments, "apiData", "s", "n").select("id", "s.chinese", "s.gloss")
    return joins.nested_rows(rows, "gloss", "token", "place").select("id", "chinese", "place", F.col("token").alias("gloss"))


@query("""select 0 as part, _ord, id, 'synth' as source, chinese, gloss_text from split_data where source = 'synth' union all select 1, _ord, id, 'twtsl-sentence', chinese, gloss_text from split_data where source = 'twtsl-sentence'
union all select 2, _ord, id, 'tslcorpus', chinese, gloss_text from scrape_tslcorpus_full union all select 3, gloss_id, 'W' || gloss_id, 'word', surface, surface from gloss_master""")
def source_union(spark: SparkSession, root: str) -> DataFrame:
    own = lambda source: table(spark, root, "split_data").filter(F.col("source") == source).select("_ord", "id", "source", "chinese", "gloss_text")
    segments = table(spark, root, "scrape_tslcorpus_full").select("_ord", "id", F.lit("tslcorpus").alias("source"), "chinese", "gloss_text")
    words = table(spark, root, "gloss_master").select(F.col("gloss_id").alias("_ord"), F.concat(F.lit("W"), "gloss_id").alias("id"), F.lit("word").alias("source"), F.col("surface").alias("chinese"), F.col("surface").alias("gloss_text"))
    return joins.in_order([own("synth"), own("twtsl-sentence"), segments, words], "_ord")


@query("""with n as (select gloss_id, unnest(aliases) as alias from gloss_master), b as (select gloss_id, regexp_replace(alias, '^(.+?)_([A-Za-z]{1,2}\\d?)$', '\\1') as alias from n),
l as (select gloss_id, list_sort(list_distinct(list(alias))) as al from b group by gloss_id)
select m.gloss_id, m.surface, list_filter(coalesce(al, []), lambda a: a <> regexp_replace(m.surface, '^(.+?)_([A-Za-z]{1,2}\\d?)$', '\\1')) as aliases from gloss_master m left join l using (gloss_id)""")
def alias_outer_join(spark: SparkSession, root: str) -> DataFrame:
    entries = table(spark, root, "gloss_master")
    return vocabulary.alias_lists(entries.select("gloss_id", "surface"), "gloss_id", "surface", entries.select("gloss_id", F.explode("aliases").alias("alias")), "alias")


@query(f"with {_MASTER} select source, count(*)::bigint as n from (select unnest(sources) as source from listed) group by source")
def vocab_sources(spark: SparkSession, root: str) -> DataFrame:
    return vocabulary.source_counts(_master(spark, root))


@query("select review_status as status, count(*)::bigint as n from split_data group by review_status")
def status_rollup(spark: SparkSession, root: str) -> DataFrame:
    return vocabulary.status_counts(table(spark, root, "split_data"), "review_status")


@query(f"""with {_RECORDS}, {_TEST}, pool as (select *, coalesce(chinese in (select chinese from test where chinese is not null) or gloss_text in (select gloss_text from test where gloss_text is not null), false) as hit from records where chinese <> '' and gloss_text <> '' and not contains(gloss_text, '＿') and confidence is distinct from 'rule-derived')
select source, count(*)::bigint as rows, (count(*) filter (hit))::bigint as dropped, (count(*) filter (not hit))::bigint as kept from pool group by source""")
def holdout_counts(spark: SparkSession, root: str) -> DataFrame:
    test = table(spark, root, "tsl_sentences").filter("split = 'test' and not coalesce(is_template, false)")
    return split.holdout_counts(_records(spark, root), test)


@query("select id, chinese from split_data p where not exists (select 1 from tsl_sentences t where t.split = 'test' and t.chinese <> '' and p.chinese <> '' and contains(p.chinese, t.chinese))")
def decontaminate_contains(spark: SparkSession, root: str) -> DataFrame:
    test = table(spark, root, "tsl_sentences").filter("split = 'test'")
    return joins.not_containing(table(spark, root, "split_data").select("id", "chinese"), "chinese", "id", test, "chinese")


@query("select 'batch' || (count(distinct source_file) + 1) as label from tsl_sentences")
def batch_label(spark: SparkSession, root: str) -> DataFrame:
    return corpus.batch_label(table(spark, root, "tsl_sentences"), "source_file")


VERB_TEMPLATES = [(1, "V1", ["{T}我{V}{P}。", "我{T}{V}{P}。"], ["{T}", "我", "{P}", "{V}"], ["書包", "手機"], ["買", "找"], ["今天", "明天"]), (2, "V2", ["我不{V}。"], ["我", "{V}", "不"], None, ["走", "說"], None)]


@query("""with t as (select 1 as ord, 'V1' as tid, ['{T}我{V}{P}。', '我{T}{V}{P}。'] as phrasings, ['{T}', '我', '{P}', '{V}'] as gloss, ['書包', '手機'] as slots, ['買', '找'] as verbs, ['今天', '明天'] as times union all select 2, 'V2', ['我不{V}。'], ['我', '{V}', '不'], [null], ['走', '說'], [null]),
e as (select tid, gloss, p, v, tm, unnest(phrasings) as phrase from (select *, unnest(times) as tm from (select *, unnest(verbs) as v from (select *, unnest(slots) as p from t)))),
f as (select tid, replace(replace(replace(phrase, '{P}', coalesce(p, '')), '{V}', coalesce(v, '')), '{T}', coalesce(tm, '')) as chinese, array_to_string(list_filter(list_transform(gloss, lambda g: replace(replace(replace(g, '{P}', coalesce(p, '')), '{V}', coalesce(v, '')), '{T}', coalesce(tm, ''))), lambda g: g <> ''), '/') as gloss_text from e)
select distinct tid, chinese, gloss_text from f where chinese not in (select chinese from tsl_sentences where chinese is not null)""")
def template_verbs(spark: SparkSession, root: str) -> DataFrame:
    templates = dimension(spark, VERB_TEMPLATES, "ord int, tid string, phrasings array<string>, gloss array<string>, slots array<string>, v_slots array<string>, times array<string>")
    return corpus.expand_templates(templates, table(spark, root, "tsl_sentences")).drop("place")


TASK, GRAMMAR = "把句子譯成手語詞序。", "時間放句首。\n否定放句尾。"


@query("select id, 'zero' as strategy, '把句子譯成手語詞序。' || chr(10) || chr(10) || '中文：' || chinese || chr(10) || 'Gloss：' as prompt from tsl_sentences where chinese is not null union all select id, 'rules', '把句子譯成手語詞序。' || chr(10) || chr(10) || '時間放句首。' || chr(10) || '否定放句尾。' || chr(10) || chr(10) || '中文：' || chinese || chr(10) || 'Gloss：' from tsl_sentences where chinese is not null")
def strategy_prompts(spark: SparkSession, root: str) -> DataFrame:
    own = table(spark, root, "tsl_sentences").filter("chinese is not null")
    each = F.array(*[F.struct(F.lit(n).alias("strategy"), prompts.prompt(TASK, F.col("chinese"), rules).alias("prompt")) for n, rules in (("zero", None), ("rules", GRAMMAR))])
    return own.select("id", F.explode(each).alias("x")).select("id", "x.strategy", "x.prompt")


_EXEMPLAR_IDS = ("S000000001", "S000000002", "S000000003")


@query(f"select id, chinese, gloss_text from tsl_sentences where id in {_EXEMPLAR_IDS}")
def exemplar_rows(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "tsl_sentences").filter(F.col("id").isin(*_EXEMPLAR_IDS)).select("id", "chinese", "gloss_text")


@query("select id, list_filter(gloss, lambda t: t is not null and not contains(t, '＿')) as gloss, regexp_full_match(source_file, '.*W\\d{2}.*') as is_word_sheet from tsl_sentences where gloss is not null and source_file is not null")
def placeholder_free(spark: SparkSession, root: str) -> DataFrame:
    own = table(spark, root, "tsl_sentences").filter("gloss is not null and source_file is not null")
    return own.select("id", arrays.without(F.col("gloss"), text.PLACEHOLDER).alias("gloss"), F.col("source_file").rlike(r"W\d{2}").alias("is_word_sheet"))
