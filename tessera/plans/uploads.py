"""Queries of sources, sinks and samples: tables stand in for uploaded files (file, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ontology
from ..operators import sampling
from ..sources import datasets, imports, sinks
from . import fixtures as fx
from .registry import query


def _joined(rows: DataFrame, key: str, order: str, value: Column, glue: str) -> DataFrame:
    """A file per key: its rows' values in order, glued."""
    items = rows.groupBy(F.col(key).cast("string").alias("file")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))).alias("a"))
    return items.select("file", F.array_join(F.transform("a", lambda x: x["v"]), glue).alias("content"))


_ENDS = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}\x{1D}\x{1E}\x{85}\x{2028}\x{2029}]"


@query(
    rf"with s as (select doc_id, regexp_split_to_array(text, '{_ENDS}') as l from documents where text is not null), k as (select doc_id, case when l[-1] = '' then l[1 : len(l) - 1] else l end as l from s) "
    "select doc_id::varchar as file, unnest(range(1, len(l) + 1))::int as ordinal, sha256(unnest(l)) as line from k"
)
def import_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = fx.table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("file"), F.col("text").alias("content"))
    return imports.text_lines(files).select("file", "ordinal", F.sha2("value", 256).alias("line"))


@query(
    "select c_nationkey::varchar as file, row_number() over (partition by c_nationkey order by c_custkey)::int as ordinal, case when c_custkey % 3 = 0 then 'say \"' || c_name || '\",' || chr(10) || 'twice' else c_name end as text from customer"
)
def import_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted fields with quotes, commas and line ends in them."""
    text = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('"say ""'), F.col("c_name"), F.lit('"",\ntwice"'))).otherwise(F.col("c_name"))
    files = _joined(fx.table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", F.concat(F.col("c_custkey").cast("string"), F.lit(","), text), "\n")
    files = files.withColumn("content", F.concat(F.lit("id,text\n"), "content"))
    return imports.csv_rows(files).select("file", "ordinal", F.col("record")["text"].alias("text"))


_ITEM = """case event_id % 5 when 0 then '{"review_text": "' || event_type || '"}' when 1 then '{"text": "' || event_type || '", "x": 1}' when 2 then '{"review_text": null, "text": "t"}' when 3 then '7' else '{"reviewText": "é"}' end"""
_ITEM_TEXT = "case event_id % 5 when 0 then event_type when 1 then event_type when 4 then 'é' end"


def _item() -> Column:
    return F.expr(_ITEM)


@query(f"select (user_id // 2)::varchar as file, row_number() over (partition by user_id // 2 order by event_id)::int as ordinal, {_ITEM_TEXT} as text, case when event_id % 5 in (2, 3) then 'Review text must be a non-empty string' end as error from events")
def import_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays, and objects with `reviews`."""
    from ..operators import validation

    rows = fx.table(spark, sf_dir, "events").withColumn("f", F.floor(F.col("user_id") / 2))
    files = _joined(rows, "f", "event_id", _item(), ", ")
    even = F.col("file").cast("long") % 2 == 0
    files = files.withColumn("content", F.when(even, F.concat(F.lit("["), "content", F.lit("]"))).otherwise(F.concat(F.lit('{"reviews": ['), "content", F.lit("]}"))))
    got = imports.json_rows(files)
    return validation.import_rows(got.select(F.struct("file", "ordinal").alias("ordinal"), "record")).select("ordinal.file", "ordinal.ordinal", "text", "error")


@query(f"select user_id::varchar as file, row_number() over (partition by user_id order by event_id)::int as ordinal, case when event_id % 7 <> 0 then {_ITEM_TEXT} end as text, case when event_id % 7 = 0 or event_id % 5 in (2, 3) then 'Review text must be a non-empty string' end as error from events")
def import_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh line is cut short, or blank."""
    from ..operators import validation

    value = F.when(F.col("event_id") % 14 == 0, "").when(F.col("event_id") % 7 == 0, F.concat(F.lit("{"), _item())).otherwise(_item())
    files = _joined(fx.table(spark, sf_dir, "events"), "user_id", "event_id", value, "\n").withColumn("content", F.concat("content", F.lit("\n")))
    got = imports.json_line_rows(files)
    return validation.import_rows(got.select(F.struct("file", "ordinal").alias("ordinal"), "record")).select("ordinal.file", "ordinal.ordinal", "text", "error")


@query(
    "with c as (select conv_id::varchar as file, case when conv_id % 4 = 0 then '' else string_agg(coalesce(text, ''), chr(10) order by turn) end as content, conv_id % 4 = 0 as none, conv_id % 50 = 7 as many from conversations group by conv_id), l as (select file, none, many, strlen(content) as b, "
    "len(string_split(content, chr(10))) - (content = '' or ends_with(content, chr(10)))::int as n from c) select file, case when many then 12002 else b end::int as bytes, case when many then 6001 else n end::bigint as rows, case when many then 'too_many_rows' when n = 0 then 'empty' end as error from l"
)
def import_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.table(spark, sf_dir, "conversations")
    files = _joined(c, "conv_id", "turn", F.coalesce("text", F.lit("")), "\n")
    k = F.col("file").cast("long")
    files = files.withColumn("content", F.when(k % 50 == 7, F.repeat(F.lit("x\n"), F.lit(6001))).when(k % 4 == 0, "").otherwise(F.col("content")))
    return imports.limits(files, imports.text_lines(files))


@query(
    "with t as (select conv_id, trim(text, ' ') as x, turn from conversations where text is not null and not contains(text, chr(10)) and not contains(text, chr(13)) and trim(text, ' ') <> '') "
    "select conv_id, row_number() over (partition by conv_id order by turn)::int as ordinal, x as review_text from t"
)
def pasted_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, one below the other with blank lines between, are one pasted text."""
    c = fx.table(spark, sf_dir, "conversations").where("text is not null and not contains(text, '\n') and not contains(text, '\r') and trim(text) <> ''")
    files = _joined(c, "conv_id", "turn", F.col("text"), "\r\n \t\n")
    return imports.pasted(files.select(F.col("file").cast("bigint").alias("conv_id"), "content")).select("conv_id", "ordinal", "review_text")


_LINE = "case p_partkey % 4 when 0 then p_name || chr(9) || '0,1 A#B 2 1,2' || chr(9) || '1,2 C#D 0 -1,-1' when 1 then p_name || ' #### 0,1 A#B 2 1,2' when 2 then p_name || ' 0,1 A#B 2 1,2 1,2 C#D 0 -1,-1' else p_name end"


@query(f"select p_partkey, case when p_partkey % 4 <> 3 then p_name end as text, case p_partkey % 4 when 0 then '0,1 A#B 2 1,2|1,2 C#D 0 -1,-1' when 1 then '0,1 A#B 2 1,2' when 2 then '0,1 A#B 2 1,2|1,2 C#D 0 -1,-1' end as quads from part")
def annotated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "part").withColumn("line", F.expr(_LINE.replace("chr(9)", "'\\t'")))
    r = datasets.split_record(F.col("line"))
    return rows.select("p_partkey", r["text"].alias("text"), F.array_join(r["annotations"], "|").alias("quads"))


@query(
    "select p_partkey, case when p_partkey % 5 < 4 then p_name end as aspect, case when p_partkey % 5 < 4 then p_type end as opinion, case p_partkey % 5 when 0 then 'positive' when 1 then 'negative' when 2 then 'neutral' when 3 then 'positive' end as sentiment from part"
)
def delimited_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.expr(
        "case p_partkey % 5 when 0 then concat('[', p_name, ' ||| X ||| pos ||| ', p_type, ']') when 1 then concat(p_name, '####X####', p_type, '####negative') when 2 then concat('(', p_name, ';X;1;', p_type, ')') when 3 then concat(p_name, '|X|2|', p_type) else concat('null', '|X|2|', p_type) end"
    )
    q = datasets.delimited_quad(token)
    return fx.table(spark, sf_dir, "part").select("p_partkey", q["aspect"].alias("aspect"), q["opinion"].alias("opinion"), q["sentiment"].alias("sentiment"))


@query("select 'd' as kind, doc_id as id, lang, null::varchar as url from documents union all select 'p', page_id, null, url from pages union all select 'b', item_id, null, null from benchmark")
def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.table(spark, sf_dir, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), "lang")
    p = fx.table(spark, sf_dir, "pages").select(F.lit("p").alias("kind"), F.col("page_id").alias("id"), "url")
    b = fx.table(spark, sf_dir, "benchmark").select(F.lit("b").alias("kind"), F.col("item_id").alias("id"))
    return datasets.union(d, p, b)


@query("select text as review_text from documents where source = 'src1' and trim(text) <> ''")
def legacy_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "documents").where("trim(text) <> ''")
    return datasets.legacy_reviews(rows.select(F.col("source").alias("product_id"), F.to_json(F.struct(F.struct(F.col("text").alias("review_text")).alias("review"))).alias("payload")), "src1")


@query("select doc_id, case when row_number() over (order by doc_id) <= count(*) over () // 2 then 'development' else 'heldout' end as split from labels")
def human_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "labels").select("doc_id")
    return datasets.human_labels(rows, "doc_id", rows.count())


_WRAPPERS = {"development": "the {} here", "heldout": "about {}"}
_UNKNOWN = {"development": ["hinge", "fan noise"], "heldout": ["warranty"]}


@query(
    "select * from (values "
    + ", ".join(f"('{s}', '{w.replace('{}', alias)}', '{a[0]}')" for s, w in _WRAPPERS.items() for a in ontology.ASPECTS for alias in a[2])
    + ", "
    + ", ".join(f"('{s}', '{t}', null)" for s, terms in _UNKNOWN.items() for t in terms)
    + ") v(split, text, gold)"
)
def synthetic_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.synthetic_examples(spark, _WRAPPERS, _UNKNOWN)


@query(
    "with n as (select n_nationkey as k, lower(replace(n_name, ' ', '_')) as id, n_name as label, n_regionkey as r from nation), a as (select case when k = 3 then 'x y' when k = 4 then (select id from n where k = 5) else id end as id, case when k = 6 then (select label from n where k = 7) else label end as label, r, k from n) "
    "select 'id_pattern' as \"check\", id as value from a where not regexp_matches(id, '^[a-z][a-z0-9_]*$') union all select 'duplicate_id', id from a group by id having count(*) > 1 union all select 'duplicate_label', lower(label) from a group by lower(label) having count(*) > 1 "
    "union all select 'alias_collision', 'region ' || r from a group by r having count(distinct id) > 1 union all select 'blank_alias', id from a where k = 8"
)
def ontology_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as aspects, with an id and labels spoilt; those of a region share an alias."""
    n = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))).alias("id"), F.col("n_name").alias("label"), F.col("n_regionkey").alias("r"))
    fifth, seventh = n.where("k = 5").first(), n.where("k = 7").first()
    own = F.when(F.col("k") == 3, "x y").when(F.col("k") == 4, fifth["id"]).otherwise(F.col("id"))
    label = F.when(F.col("k") == 6, seventh["label"]).otherwise(F.col("label"))
    aliases = F.array(F.concat(F.lit("Region "), F.col("r").cast("string")), F.when(F.col("k") == 8, "!").otherwise(F.concat(F.lit("only "), F.col("k").cast("string"))))
    return ontology.violations(n.select(own.alias("id"), label.alias("label"), aliases.alias("aliases")))


@query("select to_json({n_name: n_name, n_nationkey: n_nationkey, n_regionkey: n_regionkey})::varchar as value from nation")
def sorted_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.sorted_json(fx.table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name"))


@query("with h as (select ('0x' || substr(sha256(to_json({c_custkey: c_custkey, c_name: c_name})::varchar), 1, 15))::bigint::hugeint as h from customer) select count(*) as rows, sha256(sum(h)::hugeint::varchar) as content_sha256, 'crm' as origin from h")
def content_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.manifest(fx.table(spark, sf_dir, "customer").select("c_name", "c_custkey"), origin="crm")


@query("select sha256(string_agg(doc_id::varchar || chr(0) || sha256(text), chr(10) order by doc_id::varchar)) as sha256 from documents where text is not null")
def folder_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.table(spark, sf_dir, "documents").where("text is not null")
    return sinks.folder_hash(d.select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "utf-8").alias("content")))


@query(
    "select user_id as job_id, (event_id % 50)::int as row, case when event_id % 4 <> 0 then event_id * 10 end as source_line, event_type as error from events where event_type = 'error' "
    "union all select c_custkey, null, null, 'job failed' from customer where c_custkey not in (select user_id from events where event_type = 'error')"
)
def error_rows_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events").where("event_type = 'error'")
    e = e.select(F.col("user_id").alias("job_id"), (F.col("event_id") % 50).cast("int").alias("row"), "event_id", F.col("event_type").alias("error"))
    lines = e.where("event_id % 4 <> 0").select("job_id", F.col("event_id").alias("row"), (F.col("event_id") * 10).alias("source_line"))
    failed = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"), F.lit("job failed").alias("error"))
    got = sinks.error_export(e.select("job_id", F.col("event_id").cast("int").alias("row"), "error"), lines, failed)
    return got.withColumn("row", (F.col("row") % 50).cast("int"))


@query(f"with {fx.MENTIONS_SQL} select review_id, 'v1' as pipeline_version, aspect_id, sentiment, confidence from m")
def analysis_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.struct("aspect_id", "sentiment", "confidence")
    runs = fx.mentions(spark, sf_dir).groupBy("review_id").agg(F.collect_list(tag).alias("tags")).withColumn("pipeline_version", F.lit("v1"))
    return sinks.analysis_tables(runs)[1].drop("ordinal")


_TITLES = ("Gaming laptop 15", "Laptop sleeve", "Chromebook", "MacBook Pro", "Desk lamp")
_LEAVES = ("Laptops", "Notebook Computers", "Lamps", "Laptop Accessories", "Docking Stations")


@query(
    "with p as (select p_partkey, ['" + "', '".join(_TITLES) + "'][(p_partkey % 5 + 1)::int] as title, ['" + "', '".join(_LEAVES) + "'][(p_partkey // 5 % 5 + 1)::int] as leaf from part) select p_partkey, "
    f"(regexp_matches(leaf, '{sampling.LAPTOP}') or p_partkey % 3 = 0) and not regexp_matches(leaf, '{sampling.ACCESSORY}') and not regexp_matches(title, '{sampling.ACCESSORY_TITLE}') as laptop from p"
)
def laptops(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, at: F.element_at(F.array(*(F.lit(v) for v in values)), (at % 5 + 1).cast("int"))
    root = F.when(F.col("p_partkey") % 3 == 0, "Laptops").otherwise("Things")
    categories = F.array(root, pick(_LEAVES, F.floor(F.col("p_partkey") / 5)))
    return fx.table(spark, sf_dir, "part").select("p_partkey", sampling.is_laptop(pick(_TITLES, F.col("p_partkey")), categories).alias("laptop"))


@query("select p_partkey, case p_partkey % 4 when 0 then p_brand when 1 then p_name when 2 then p_type end as brand from part")
def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    own = F.when(k == 0, F.concat(F.lit(" "), F.col("p_brand"), F.lit(" "))).when(k == 1, " ")
    details = F.when(k == 3, "{broken").when(k == 2, F.to_json(F.struct(F.col("p_type").alias("brand")))).otherwise(F.to_json(F.struct(F.col("p_name").alias("Brand"))))
    return fx.table(spark, sf_dir, "part").select("p_partkey", sampling.brand(own, details).alias("brand"))


_REJECTED = (
    "case when event_id % 19 = 0 then 'malformed' when user_id % 4 = 0 then 'outside_pool' when event_type = 'view' then 'missing_text' when event_id % 11 = 0 then 'missing_timestamp' when not coalesce(event_id % 8 between 1 and 5, false) then 'invalid_rating' "
    "when event_id % 3 = 0 then 'duplicate' when event_id % 7 = 0 then 'over_cap' end"
)


@query(f"select coalesce({_REJECTED}, 'taken') as reason, count(*) as rows from events group by 1")
def rejection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    reason = sampling.rejection(i % 19 != 0, F.col("user_id") % 4 != 0, F.when(F.col("event_type") != "view", F.col("event_type")), F.when(i % 11 != 0, F.col("ts")), i % 8, i % 3 == 0, i % 7 == 0)
    return fx.table(spark, sf_dir, "events").groupBy(F.coalesce(reason, F.lit("taken")).alias("reason")).agg(F.count("*").alias("rows"))


@query("select event_id, case when event_id % 3 = 0 then event_id % 10 else 0 end as votes from events")
def helpful_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as text; those that are negative or none are 0."""
    i = F.col("event_id")
    value = F.when(i % 3 == 0, (i % 10).cast("string")).when(i % 3 == 1, F.concat(F.lit("-"), (i % 10 + 1).cast("string"))).otherwise("many")
    return fx.table(spark, sf_dir, "events").select("event_id", sampling.helpful_votes(value).alias("votes"))
