"""Views of the test tables as the engine's inputs, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ontology
from ..session import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_array():
    return F.array(*(F.lit(i) for i in ontology.IDS))


def mentions(spark: SparkSession, sf_dir: str, unknowns: bool = False) -> DataFrame:
    """Lines of orders as mentions of aspects in reviews of products."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    lines, orders = dealt(lines.count(), (lines, "l_orderkey"), (orders, "o_orderkey"))
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    product, ix = F.col("o_custkey") % 400, F.col("l_partkey") % 21
    bias = (product * 7 + ix * 3) % 13
    roll = (F.col("l_suppkey") * 13 + F.col("l_linenumber") * 7 + F.col("l_partkey")) % 10
    aspect = F.element_at(id_array(), (ix + 1).cast("int"))
    rows = rows.select(
        product.alias("product_id"),
        F.col("o_orderkey").alias("review_id"),
        ix.alias("aspect_ix"),
        (F.when(F.col("l_suppkey") % 17 != 0, aspect) if unknowns else aspect).alias("aspect_id"),
        F.when((bias == 12) | (roll == 9), "neutral").when(roll < bias, "positive").otherwise("negative").alias("sentiment"),
        (F.lit(0.5) + F.col("l_discount") * 4).alias("confidence"),
        (F.floor("o_totalprice") % 50).alias("helpful_votes"),
        roll.alias("roll"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate").alias("ordinal"),
    )
    return rows


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select((F.col("o_custkey") % 400).alias("product_id"), F.col("o_orderkey").alias("review_id"), (F.floor("o_totalprice") % 50).alias("helpful_votes"), F.col("o_orderdate").alias("submitted_at"))


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each review, with its mentions as tags; some have none."""
    tag = F.struct("aspect_id", "sentiment", "confidence")
    tags = mentions(spark, sf_dir).groupBy("review_id").agg(F.collect_list(tag).alias("tags"))  # lines of one order
    return reviews(spark, sf_dir).join(tags, "review_id", "left")


def review_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences made from mentions, one review each; some begin with an emoji, to keep offsets honest."""
    m = mentions(spark, sf_dir)
    first = lambda ix: F.element_at(F.array(*(F.lit(a[2][0]) for a in ontology.ASPECTS)), (ix % 21 + 1).cast("int"))
    word = lambda ix: F.element_at(F.array(*(F.lit(w) for w in ("great", "terrible", "fine", "slow", "reliable"))), (ix % 5 + 1).cast("int"))
    second = F.when(F.col("roll") % 3 == 0, F.concat(F.lit(", but the "), first(F.col("aspect_ix") + 5), F.lit(" is "), word(F.col("roll") + 2))).otherwise("")
    lead = F.when(F.col("review_id") % 50 == 0, "😀 ").otherwise("")
    body = F.concat(lead, F.lit("The "), first(F.col("aspect_ix")), F.lit(" is "), F.when(F.col("roll") % 4 == 1, "not ").otherwise(""), word(F.col("roll")), second, F.lit("."))
    return m.select("product_id", "review_id", body.alias("review_text")).distinct()


IDS_SQL = "[" + ", ".join(f"'{i}'" for i in ontology.IDS) + "]"
LABELS_SQL = "map {" + ", ".join(f"'{i}': '{label}'" for i, label in ontology.LABELS.items()) + "}"
TAGS_SQL = "map {" + ", ".join(f"'{i}/{s}': '{ontology.tag_text(i, s)}'" for i in ontology.IDS for s in ontology.SENTIMENTS) + "}"

MENTIONS_SQL = f"""
f0 as (select o_custkey % 400 as product_id, o_orderkey as review_id, l_partkey % 21 as aspect_ix, ((o_custkey % 400) * 7 + (l_partkey % 21) * 3) % 13 as bias,
  (l_suppkey * 13 + l_linenumber * 7 + l_partkey) % 10 as roll, 0.5::double + l_discount * 4 as confidence, floor(o_totalprice)::bigint % 50 as helpful_votes,
  l_suppkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate
  from lineitem join orders on l_orderkey = o_orderkey),
m as (select *, {IDS_SQL}[(aspect_ix + 1)::int] as aspect_id, case when bias = 12 or roll = 9 then 'neutral' when roll < bias then 'positive' else 'negative' end as sentiment from f0)"""

VOTES_SQL = MENTIONS_SQL + """,
v0 as (select product_id, review_id, aspect_id, bool_or(sentiment = 'positive') as pos, bool_or(sentiment = 'negative') as neg, min(confidence) as confidence, count(*) as mention_count from m group by all),
v as (select product_id, review_id, aspect_id, case when pos and neg then 'neutral' when pos then 'positive' when neg then 'negative' else 'neutral' end as vote, pos and neg as contradictory, confidence, mention_count from v0)"""


def classify_sql(positive: str, neutral: str, negative: str) -> str:
    n = f"({positive} + {neutral} + {negative})"
    return (
        f"(case when {n} < 3 then 'insufficient_evidence' when {neutral} = {n} then 'neutral' when {positive}::double / {n} >= 0.80::double then 'excellent' when {positive}::double / {n} >= 0.60::double then 'good' "
        f"when {negative}::double / {n} >= 0.70::double then 'poor' when {negative}::double / {n} >= 0.50::double then 'weak' else 'mixed' end)"
    )


ASPECTS_SQL = VOTES_SQL + f""",
a0 as (select product_id, aspect_id, sum(mention_count)::bigint as mention_count, count(*) as review_count, count_if(contradictory)::bigint as contradictory_review_count,
  count_if(vote = 'positive')::bigint as positive, count_if(vote = 'neutral')::bigint as neutral, count_if(vote = 'negative')::bigint as negative, avg(confidence) as ac from v group by all),
a1 as (select *, positive / review_count as positive_ratio, neutral / review_count as neutral_ratio, negative / review_count as negative_ratio, {classify_sql("positive", "neutral", "negative")} as classification from a0),
a2 as (select *, round(ln(1 + review_count) * ac * abs(positive_ratio - negative_ratio), 9) as score, round(ac, 9) as average_confidence,
  case when classification in ('excellent', 'good') then {TAGS_SQL}[aspect_id || '/positive'] when classification in ('poor', 'weak') then {TAGS_SQL}[aspect_id || '/negative']
    when classification = 'neutral' then {TAGS_SQL}[aspect_id || '/neutral'] when classification = 'mixed' then 'Mixed ' || {LABELS_SQL}[aspect_id] || ' Feedback' end as aggregate_tag from a1),
a as (select * exclude (ac), case when classification <> 'insufficient_evidence' then row_number() over (partition by product_id order by (classification <> 'insufficient_evidence')::int desc, score desc, review_count desc, aspect_id) end as rank from a2)"""

FIRST_SQL = "[" + ", ".join(f"'{a[2][0]}'" for a in ontology.ASPECTS) + "]"
_WORD_SQL = "['great', 'terrible', 'fine', 'slow', 'reliable']"
_SIGN_SQL = "case {0} when 'great' then 1 when 'reliable' then 1 when 'terrible' then -1 when 'slow' then -1 else 0 end"

# The same sentences, and the mentions that they were made of: every place follows from the lengths of the parts.
REVIEWS_SQL = MENTIONS_SQL + f""",
rt0 as (select distinct product_id, review_id, review_id % 50 = 0 as lead, aspect_ix % 21 as ix1, (aspect_ix + 5) % 21 as ix2, {_WORD_SQL}[(roll % 5 + 1)::int] as w1, roll % 4 = 1 as neg, roll % 3 = 0 as more, {_WORD_SQL}[((roll + 2) % 5 + 1)::int] as w2 from m),
rt1 as (select distinct product_id, review_id, lead, ix1, w1, neg, more, case when more then ix2 end as ix2, case when more then w2 end as w2 from rt0),
rt2 as (select *, {FIRST_SQL}[(ix1 + 1)::int] as a1, {FIRST_SQL}[(ix2 + 1)::int] as a2 from rt1),
rt as (select *, case when lead then '😀 ' else '' end || 'The ' || a1 || ' is ' || case when neg then 'not ' else '' end || w1 || case when more then ', but the ' || a2 || ' is ' || w2 else '' end || '.' as review_text,
  case when lead then 2 else 0 end + 8 + length(a1) + case when neg then 4 else 0 end + length(w1) as after_first from rt2),
rm0 as (select product_id, review_id, review_text, 0 as ordinal, ix1 as ix, case when lead then 6 else 4 end as start_char, a1 as raw_aspect, 0 as context_start_char, after_first + case when more then 1 else 0 end as context_end_char,
    ({_SIGN_SQL.format("w1")}) * case when neg then -1 else 1 end as sign from rt
  union all select product_id, review_id, review_text, 1, ix2, after_first + 10, a2, after_first + 6, length(review_text) - 1, {_SIGN_SQL.format("w2")} from rt where more),
rm as (select product_id, review_id, review_text, ordinal::int as ordinal, raw_aspect, start_char::int as start_char, (start_char + length(raw_aspect))::int as end_char, {IDS_SQL}[(ix + 1)::int] as normalized_aspect_id,
  case when sign > 0 then 'positive' when sign < 0 then 'negative' else 'neutral' end as sentiment, case when sign = 0 then 0.5::double else 0.72::double end as confidence, context_start_char::int as context_start_char, context_end_char::int as context_end_char from rm0)"""
