"""Queries of the sampled review stream and of numbered lines: parts as product metadata, events as reviews."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import review_stream, sampling
from ..session import shared_folder
from ..sources import numbered
from . import fixtures as fx
from .registry import query

CAP, POOL, PRODUCTS = 12, 40, 20
ROUNDS = 14

_METADATA_SQL = f"""
m0 as (select p_partkey as place, case when p_partkey % 17 = 0 then ' ' else 'P' || (p_partkey % 130) end as product, p_name as title, [p_type, case when p_size < 30 then 'Laptops' else p_name end, case when p_size % 7 = 0 then 'Laptop Bags' else p_name end] as c, p_brand, p_partkey % 23 <> 0 as ok from part),
m1 as (select *, case when not ok then 'malformed' when trim(product) = '' then 'missing_product'
  when not (len(list_filter(c, lambda x : regexp_matches(x, '{sampling.LAPTOP}'))) > 0 and not regexp_matches(c[-1], '{sampling.ACCESSORY}') and not regexp_matches(title, '{sampling.ACCESSORY_TITLE}')) then 'non_laptop' end as reason from m0),
first as (select product, min(place) as starts, arg_min(p_brand, place) as brand from m1 where reason is null group by product),
pool as (select product, brand from first order by sha256('42:' || product), product limit {POOL}),
"""
_REVIEWS_SQL = """
r0 as (select event_id as place, 'P' || (user_id * user_id % 130) as product, case when event_id % 4 = 0 then 'r' || (event_id * 7919 % 1500) end as own_id, case when event_type <> 'view' then event_type || ' ' || floor(value / 20)::bigint end as text,
  case when floor(value)::bigint % 11 <> 0 then strftime(ts, '%Y-%m-%d') end as time, floor(value)::bigint % 8 as rating, json_extract(props, '$.k')::bigint - 5 as votes, event_id % 19 <> 0 as ok from events),
r1 as (select r0.*, case when not ok then 'malformed' when product not in (select product from pool) then 'outside_pool' when text is null then 'missing_text' when time is null then 'missing_timestamp' when not rating between 1 and 5 then 'invalid_rating' end as failed from r0),
good as (select *, coalesce(own_id, sha256(product || chr(0) || time || chr(0) || text)) as rid from r1 where failed is null),
offers as (select rid, product, min(place) as place from good group by rid, product),
l0 as (select ''::varchar as product, 0::bigint as lim where false),
"""
_ROUND_SQL = """
b{1} as (select rid, arg_min(product, place) as product, min(place) as place from offers left join l{0} using (product) where lim is null or place <= lim group by rid),
h{1} as materialized (select *, row_number() over (partition by product order by place) as n from b{1}), l{1} as (select product, place as lim from h{1} where n = {2}),
"""
_VERDICTS_SQL = (
    "with "
    + _METADATA_SQL
    + _REVIEWS_SQL
    + "".join(_ROUND_SQL.format(i, i + 1, CAP) for i in range(ROUNDS))
    + f"""
held as (select rid, place as taken_at from h{ROUNDS} where n <= {CAP}),
v as (select r1.place, r1.product, good.rid as review_id, r1.text, r1.rating, r1.time, case when r1.votes >= 0 then r1.votes else 0 end as helpful_votes, r1.votes < 0 as odd,
  coalesce(r1.failed, case when taken_at is null or r1.place < taken_at then 'over_cap' when r1.place > taken_at then 'duplicate' end) as reason from r1 left join good using (place) left join held using (rid)),
s as (select product, count(*) as reviews from v where reason is null group by product),
chosen as (select product, reviews, row_number() over (order by reviews < 3, sha256('42:' || product), product) as rank from s qualify rank <= {PRODUCTS}),
taken as (select c.rank, v.* from v join chosen c using (product) where reason is null)
"""
)


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    kind, leaf = F.when(F.col("p_size") < 30, "Laptops").otherwise(F.col("p_name")), F.when(F.col("p_size") % 7 == 0, "Laptop Bags").otherwise(F.col("p_name"))
    product = F.when(key % 17 == 0, " ").otherwise(F.concat(F.lit("P"), key % 130, F.lit(" ")))
    return fx.table(spark, sf_dir, "part").select(
        key.alias("place"), (key % 23 != 0).alias("row_ok"), product.alias("product"), F.col("p_name").alias("title"), F.array("p_type", kind, leaf).alias("categories"), F.lit(" ").alias("brand"),
        F.to_json(F.struct(F.col("p_brand").alias("Brand"))).alias("details"),
    )


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, whole = F.col("event_id"), F.floor("value")
    return fx.table(spark, sf_dir, "events").select(
        i.alias("place"), (i % 19 != 0).alias("row_ok"), F.concat(F.lit("P"), F.col("user_id") * F.col("user_id") % 130).alias("product"), F.when(i % 4 == 0, F.concat(F.lit(" r"), i * 7919 % 1500)).alias("own_id"),
        F.when(F.col("event_type") != "view", F.concat("event_type", F.lit(" "), F.floor(F.col("value") / 20))).alias("text"), F.when(whole % 11 != 0, F.date_format("ts", "yyyy-MM-dd")).alias("time"),
        (whole % 8).alias("rating"), (F.get_json_object("props", "$.k").cast("long") - 5).cast("string").alias("helpful"),
    )


@query(_VERDICTS_SQL + "select place, product, review_id, reason from v")
def stream_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each event of the stream is not taken as a review, and the id of those that pass the checks before the cap."""
    pool, _ = review_stream.candidates(_metadata(spark, sf_dir), POOL)
    return review_stream.judged(_reviews(spark, sf_dir), pool, CAP).select("place", "product", "review_id", "reason")


@query(_VERDICTS_SQL + "select rank, place, review_id, t.product, brand, text, rating, helpful_votes, time from taken t join pool using (product)")
def stream_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reviews of the products chosen, with their product's data."""
    rows, _ = review_stream.sample(_metadata(spark, sf_dir), _reviews(spark, sf_dir), PRODUCTS, CAP, POOL)
    return rows.select("rank", "place", "review_id", "product", "brand", "text", "rating", "helpful_votes", "time")


@query(
    _VERDICTS_SQL
    + """, m2 as (select m1.*, case when reason is null and place <> starts then 'duplicate_product' else reason end as why from m1 left join first using (product))
select 'metadata_' || coalesce(why, 'taken') as counter, count(*) as rows from m2 group by 1 union all select 'metadata_rows_scanned', count(*) from m2 union all
select 'reviews_' || coalesce(reason, 'taken'), count(*) from v group by 1 union all select 'reviews_rows_scanned', count(*) from v union all
select 'reviews_invalid_helpful_votes', count(*) from v where review_id is not null and odd union all select 'candidate_products', count(*) from pool union all
select 'selected_products', count(*) from chosen union all select 'selected_products_with_three_reviews', count(*) from chosen where reviews >= 3 union all select 'selected_reviews', count(*) from taken"""
)
def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One counter for each reason that a row of the metadata or of the stream is left out, and of what is chosen."""
    return review_stream.sample(_metadata(spark, sf_dir), _reviews(spark, sf_dir), PRODUCTS, CAP, POOL)[1]


_LINES_SQL = """with j as (select event_id, user_id, event_type, case when event_id % 13 = 0 then '{broken é ' || user_id else '{"e":' || event_id || ',"u":' || user_id || ',"t":"' || event_type || '"}' end as value from events),
l as (select *, row_number() over (order by event_id) as line, sum(octet_length(encode(value)) + 1) over (order by event_id) as stop from j)"""
BYTES = 200_000
BATCH = 250


def _written(spark: SparkSession, sf_dir: str) -> str:
    """Events as JSON lines in eight files, in order; some are broken."""
    i = F.col("event_id")
    value = F.when(i % 13 == 0, F.concat(F.lit("{broken é "), "user_id")).otherwise(F.concat(F.lit('{"e":'), i, F.lit(',"u":'), "user_id", F.lit(',"t":"'), "event_type", F.lit('"}')))
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    fx.table(spark, sf_dir, "events").repartitionByRange(8, "event_id").sortWithinPartitions("event_id").select(value.alias("value")).write.text(path)
    return path


@query(f"{_LINES_SQL} select line, case when event_id % 13 <> 0 then value end as value, event_id % 13 = 0 as malformed from l where stop <= {BYTES}")
def bounded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines within a budget of bytes, with their ordinals over all files."""
    return numbered.bounded(spark, _written(spark, sf_dir), max_bytes=BYTES)[0]


@query(f"{_LINES_SQL} select line, ((row_number() over (order by line) - 1) // {BATCH})::bigint as batch, value from l where event_type = 'click' and event_id % 13 <> 0")
def line_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks in batches, in the order of their lines."""
    return numbered.in_batches(spark, _written(spark, sf_dir), F.get_json_object("value", "$.t") == "click", BATCH)
