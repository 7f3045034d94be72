"""Queries of the text, span and analysis operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ontology, sentiment, text
from ..operators import metrics, reports, retrieval, sampling, serving, spans, validation, votes
from ..operators.dedup import ordered_unique
from ..session import shared_folder
from ..streaming import publish
from . import fixtures as fx
from .registry import query

_LIST = "array_to_string({0}, ',')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "documents").where("text is not null")


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "conversations").where("text is not null")


def _choice(values: tuple[str | None, ...], at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (at % len(values) + 1).cast("int"))


def _choice_sql(values: tuple[str | None, ...], at: str) -> str:
    return "[" + ", ".join("null" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + f"][({at} % {len(values)} + 1)::int]"


_MENTION = "select product_id, review_id, review_text, ordinal, raw_aspect, start_char, end_char"


@query(f"with {fx.REVIEWS_SQL} select review_id, review_text, raw_aspect, start_char, end_char, 0.8::double as confidence from rm")
def extract_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.review_texts(spark, sf_dir).select("review_id", "review_text", F.explode(sentiment.extract_aspects(F.col("review_text"))).alias("a")).select("review_id", "review_text", "a.*")


@query(
    f"with {fx.REVIEWS_SQL} {_MENTION}, {fx.LABELS_SQL}[normalized_aspect_id] as normalized_aspect, normalized_aspect_id, 'alias' as normalization_method, 1.0::double as similarity, sentiment, confidence, "
    f"0.8::double as aspect_confidence, confidence as sentiment_confidence, context_start_char, context_end_char, {fx.TAGS_SQL}[normalized_aspect_id || '/' || sentiment] as tag from rm"
)
def analyze_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.analyze(fx.review_texts(spark, sf_dir)).drop("probabilities")


@query(f"with {fx.REVIEWS_SQL} select review_id, ordinal, substr(review_text, context_start_char + 1, context_end_char - context_start_char) as context, context_start_char, context_end_char from rm")
def clause_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.review_texts(spark, sf_dir).select("review_id", "review_text", F.posexplode(sentiment.extract_aspects(F.col("review_text"))).alias("ordinal", "a"))
    rows = rows.withColumn("c", sentiment.clause_context(F.col("review_text"), F.col("a.start_char"), F.col("a.end_char")))
    return rows.select("review_id", "ordinal", F.col("c.context").alias("context"), F.col("c.start_char").alias("context_start_char"), F.col("c.end_char").alias("context_end_char"))


@query(
    f"with {fx.REVIEWS_SQL} select review_id, start_char, c.name as \"check\" from rm, (select unnest(['span_text', 'confidence', 'context']) as name) c "
    "where (c.name = 'span_text' and review_id % 7 = 0) or (c.name = 'confidence' and review_id % 11 = 0) or (c.name = 'context' and review_id % 13 = 0)"
)
def mention_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses spoilt in three ways."""
    rows = sentiment.analyze(fx.review_texts(spark, sf_dir))
    spoilt = rows.withColumns(
        {
            "raw_aspect": F.when(F.col("review_id") % 7 == 0, F.concat("raw_aspect", F.lit("x"))).otherwise(F.col("raw_aspect")),
            "confidence": F.when(F.col("review_id") % 11 == 0, F.col("confidence") - 0.1).otherwise(F.col("confidence")),
            "context_start_char": F.when(F.col("review_id") % 13 == 0, F.col("start_char") + 1).otherwise(F.col("context_start_char")),
        }
    )
    return validation.mentions(spoilt, ["review_id", "start_char"])


@query(f"with {fx.ASPECTS_SQL} select product_id, aspect_id, c.name as \"check\" from a, (select unnest(['votes', 'ratios', 'mentions']) as name) c where (c.name in ('votes', 'ratios') and product_id % 9 = 0) or (c.name = 'mentions' and product_id % 8 = 0)")
def insight_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published table spoilt in two ways."""
    table = votes.product_ranking(fx.mentions(spark, sf_dir))
    spoilt = table.withColumn("positive", F.col("positive") + F.when(F.col("product_id") % 9 == 0, 1).otherwise(0)).withColumn("mention_count", F.when(F.col("product_id") % 8 == 0, F.col("review_count") - 1).otherwise(F.col("mention_count")))
    return validation.insights(spoilt)


@query(f"with {fx.ASPECTS_SQL} select product_id, aspect_id, 'not_listed' as \"check\" from a where review_count <= 2")
def unlisted_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = votes.product_ranking(fx.mentions(spark, sf_dir))
    return validation.unlisted(table, votes.buckets(table.where("review_count > 2")))


@query(f"with {fx.REVIEWS_SQL} select review_id, ordinal, raw_aspect, start_char from rm")
def utf16_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets as a browser counts them, an emoji as two, brought back to code points."""
    rows = sentiment.analyze(fx.review_texts(spark, sf_dir)).select("review_id", "review_text", "ordinal", "raw_aspect", "start_char", "end_char")
    shift = F.when(F.col("review_id") % 50 == 0, 1).otherwise(0)
    back = text.utf16_to_code_points(F.col("review_text"), F.col("start_char") + shift, F.col("end_char") + shift)
    return rows.withColumn("b", back).where(text.slice_text(F.col("review_text"), F.col("b.start_char"), F.col("b.end_char")) == F.col("raw_aspect")).select("review_id", "ordinal", "raw_aspect", F.col("b.start_char").alias("start_char"))


@query("select doc_id, sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) as key from documents where text is not null")
def alias_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha2(text.alias_key(F.col("text")), 256).alias("key"))


@query(r"with t as (select doc_id, text, array_to_string(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+'), ' ') as k from documents where text is not null) select doc_id, sha256(case when k = '' then trim(text) else k end) as key from t")
def token_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha2(text.token_key(F.col("text")), 256).alias("key"))


_SPACE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query(f"select doc_id, sha256(replace(lower(trim(regexp_replace(text, '{_SPACE}', ' ', 'g'))), 'ß', 'ss')) as key, sha256(lower(regexp_replace(text, '{_SPACE}', ' ', 'g'))) as captured from documents where text is not null")
def folded_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.product_text_key(F.col("text")).alias("key"), F.sha2(text.capture_key(F.col("text")), 256).alias("captured"))


@query("select conv_id, turn, case when conv_id % 3 = 0 then 'c' || conv_id else sha256(role || chr(0) || turn::varchar || chr(0) || text) end as review_id from conversations where text is not null")
def review_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("c"), F.col("conv_id").cast("string"))).otherwise(" ")
    return _said(spark, sf_dir).select("conv_id", "turn", sampling.review_id(own, F.col("role"), F.col("turn"), F.col("text")).alias("review_id"))


@query(f"with l as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, [l_partkey % 5, l_suppkey % 5, l_linenumber::bigint % 5] as x from lineitem) select l_orderkey, l_linenumber, l_partkey, l_suppkey, {_LIST.format('list_filter(x, lambda v, i : list_position(x, v) = i)')} as ids from l")
def ordered_unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array(*((F.col(c).cast("long") % 5) for c in ("l_partkey", "l_suppkey", "l_linenumber")))
    return fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(ordered_unique(ids).cast("array<string>"), ",").alias("ids"))


@query(
    "with t as (select doc_id, text, lower(text) as l, strpos(lower(text), 'an') as p from documents where text is not null), n as (select *, ((length(l) - length(replace(l, 'an', ''))) // 2)::int as n, case when p > 0 then strpos(substr(l, p + 2), 'an') else 0 end as q from t) "
    "select doc_id, n, (case when n = 1 then p - 1 end)::int as alone, (case when n >= 2 then p + q end)::int as second, case when n >= 2 then substr(text, p + 1 + q, 2) end as said, (case when n >= 2 then p + q end)::int as next_free from n"
)
def phrase_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).withColumn("found", text.phrase_spans(F.col("text"), F.lit("an")))
    second = text.nth_phrase_span(F.col("text"), F.lit("an"), F.lit(2))
    rows = rows.withColumn("second", second).withColumn("free", text.locate_span(F.col("text"), F.lit("an"), F.slice("found", 1, 1)))
    return rows.select(
        "doc_id",
        F.size("found").alias("n"),
        text.unique_phrase_span(F.col("text"), F.lit("an"))["start_char"].alias("alone"),
        F.col("second.start_char").alias("second"),
        text.slice_text(F.col("text"), F.col("second.start_char"), F.col("second.end_char")).alias("said"),
        F.col("free.start_char").alias("next_free"),
    )


@query(r"select conv_id, turn, nullif(regexp_extract(text, '^\s*\S+\s+(\S+\s+\S+\s+\S+)', 1), '') as words from conversations where text is not null")
def indexed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir).select("conv_id", "turn", text.indexed_words(F.col("text"), F.lit(1), F.lit(4)).alias("words"))


@query("select doc_id, sha256(text) as whole, ((length(text) - length(replace(lower(text), 'an', ''))) // 2)::int as highlighted from documents where text is not null and length(text) < 2000 and length(lower(text)) = length(text)")
def highlight_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).where("length(text) < 2000 and length(lower(text)) = length(text)")
    rows = rows.withColumn("s", text.segments(F.col("text"), text.phrase_spans(F.col("text"), F.lit("an"))))
    return rows.select("doc_id", F.sha2(F.array_join(F.transform("s", lambda x: x["text"]), ""), 256).alias("whole"), F.size(F.filter("s", lambda x: x["highlighted"])).alias("highlighted"))


_SPELLINGS = ("0", "NEG", " Negative ", "1", "neu", "x", "2", "POS", "positive", "")
_PARTS = ("a:train:1", "a:dev:1", "a:validation:2", "a:test:3", "b")


@query(
    f"with e as (select event_id, trim(lower({_choice_sql(_SPELLINGS, 'event_id')})) as v, {_choice_sql(_PARTS, 'event_id')} as r, event_type from events) select event_id, "
    "case when v in ('0', 'neg', 'negative') then 'negative' when v in ('1', 'neu', 'neutral') then 'neutral' when v in ('2', 'pos', 'positive') then 'positive' end as label, "
    "case when r like '%:train:%' then 'train' when r like '%:dev:%' or r like '%:validation:%' then 'validation' when r like '%:test:%' then 'test' else 'train' end as split, 'aspect: ' || event_type || ' [SEP] review: ' || r as pair from e"
)
def label_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _choice(_PARTS, F.col("event_id"))
    return fx.table(spark, sf_dir, "events").select("event_id", text.sentiment_label(_choice(_SPELLINGS, F.col("event_id"))).alias("label"), text.split_of(part).alias("split"), text.aspect_review_pair(F.col("event_type"), part).alias("pair"))


@query(
    f"with {fx.MENTIONS_SQL} select distinct aspect_id, sentiment, {fx.TAGS_SQL}[aspect_id || '/' || sentiment] as by_id, {fx.TAGS_SQL}[aspect_id || '/' || sentiment] as by_label, null::varchar as unknown, aspect_id as of_id, aspect_id as of_label, aspect_id as of_alias, null::varchar as of_none from m"
)
def tag_wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags and ids from ids, labels and aliases, whatever their case."""
    m = fx.mentions(spark, sf_dir).select("aspect_id", "sentiment", "aspect_ix").distinct()
    label = ontology.label_of(F.col("aspect_id"))
    alias = F.element_at(F.array(*(F.lit(a[2][-1].upper()) for a in ontology.ASPECTS)), (F.col("aspect_ix") % 21 + 1).cast("int"))
    tag = lambda c: ontology.generate_tag(c, F.col("sentiment"))
    return m.select(
        "aspect_id", "sentiment", tag(F.col("aspect_id")).alias("by_id"), tag(F.upper(label)).alias("by_label"), tag(F.lit("Nothing known")).alias("unknown"),
        ontology.canonical_id(F.col("aspect_id")).alias("of_id"), ontology.canonical_id(label).alias("of_label"), ontology.canonical_id(alias).alias("of_alias"), ontology.canonical_id(F.lit("nothing")).alias("of_none"),
    )


_POSITIVE, _NEGATIVE, _NEGATIONS = ("[" + ", ".join("'" + w.replace("'", "''") + "'" for w in x) + "]" for x in (sentiment.POSITIVE, sentiment.NEGATIVE, sentiment.NEGATIONS))
_LEXICON = f"""
x0 as (select review_id, review_text, regexp_extract_all(lower(review_text), '[a-z]+(?:n''t)?') as t from (select distinct review_id, review_text from rt)),
x1 as (select review_id, review_text, list_transform(range(1, len(t) + 1), lambda i : case when not list_contains({_POSITIVE}, t[i]) and not list_contains({_NEGATIVE}, t[i]) then 0
  when list_contains({_POSITIVE}, t[i]) <> list_has_any(t[greatest(i - 3, 1) : i - 1], {_NEGATIONS}) then 1 else -1 end) as s from x0),
x2 as (select *, len(list_filter(s, lambda v : v = 1)) as p, len(list_filter(s, lambda v : v = -1)) as n from x1)"""


@query(f"with {fx.REVIEWS_SQL}, {_LEXICON} select review_id, review_text, case when p > n then 'positive' when n > p then 'negative' else 'neutral' end as label, round(case when p = n then 0.5::double else least(0.99::double, 0.6::double + 0.12::double * greatest(p, n)) end, 4) as confidence from x2")
def review_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole reviews by the lexicon."""
    rows = fx.review_texts(spark, sf_dir).select("review_id", "review_text").distinct()
    s = sentiment.lexicon_sentiment(F.col("review_text"))
    return rows.select("review_id", "review_text", s["label"].alias("label"), s["confidence"].alias("confidence"))


def _labels(at: str) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.when((F.col(at) * 7 + i * i) % 4 == 0, "B-ASP").when((F.col(at) * 7 + i * i + i) % 4 == 1, "I-ASP").otherwise("O"))


def _labels_sql(at: str) -> str:
    return f"list_transform(range(0, 12), lambda i : case when ({at} * 7 + i * i) % 4 = 0 then 'B-ASP' when ({at} * 7 + i * i + i) % 4 = 1 then 'I-ASP' else 'O' end)"


_BIO = f"""t as (select o_orderkey as id, unnest({_labels_sql("o_orderkey")}) as label, unnest(range(0, 12)) as pos from orders),
u as (select *, lag(label, 1, 'O') over (partition by id order by pos) as before from t), v as (select *, label = 'B-ASP' or (label = 'I-ASP' and before = 'O') as opens from u),
w as (select *, sum(opens::int) over (partition by id order by pos) as run from v), r as (select id, run, min(pos) as a, max(pos) + 1 as b, arg_min(label, pos) as head from w where label <> 'O' group by 1, 2)"""


@query(f"with {_BIO}, g as (select id, string_agg(a || '-' || b, ',' order by a) as every, string_agg(case when head = 'B-ASP' then a || '-' || b end, ',' order by a) as strict from r group by 1) select o_orderkey as id, coalesce(every, '') as every, coalesce(strict, '') as strict from orders left join g on id = o_orderkey")
def bio_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), _labels("o_orderkey").alias("labels"))
    said = lambda opens: F.array_join(F.transform(spans.bio_runs(F.col("labels"), opens), lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",")
    return rows.select("id", said(True).alias("every"), said(False).alias("strict"))


@query(
    f"with p as (select unnest({_labels_sql('o_orderkey')}) as g, unnest({_labels_sql('(o_orderkey + 1 - o_orderkey % 3 // 2)')}) as q from orders), "
    "k as (select s.l as label, count_if(g = s.l)::bigint as support, count_if(q = s.l) as pred, count_if(g = s.l and q = s.l) as tp from p, (select unnest(['B-ASP', 'I-ASP', 'O']) as l) s group by 1), c as (select coalesce(tp / nullif(pred, 0), 0) as a, coalesce(tp / nullif(support, 0), 0) as b from k) "
    "select (select round(count_if(g = q) / count(*), 9) from p) as accuracy, (select count(*) from p) as support, round(avg(a), 9) as macro_precision, round(avg(b), 9) as macro_recall, round(avg(coalesce(2 * a * b / nullif(a + b, 0), 0)), 9) as macro_f1 from c"
)
def token_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") + 1 - F.floor(F.col("o_orderkey") % 3 / 2)).alias("other"))
    return metrics.token_metrics(rows.select(_labels("o_orderkey").alias("gold"), _labels("other").alias("predicted")))


@query(
    "with d as (select doc_id, string_split(text, ' ') as t from documents where text is not null), s as (select doc_id, t, len(t) as n, (len(t) // 2) as a, least(len(t) // 2 + 2, len(t)) as b from d), "
    "c as (select doc_id, t, n, greatest(0, least(a - floor((20 - (b - a)) / 2)::int, n - 20)) as low from s) select doc_id, sha256(array_to_string(case when n <= 20 then t else t[low + 1 : low + 20] end, ' ')) as context from c"
)
def centred_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.split("text", " ", -1)
    start = F.floor(F.size(t) / 2).cast("int")
    return _docs(spark, sf_dir).select("doc_id", F.sha2(F.array_join(spans.centred_context(t, start, F.least(start + 2, F.size(t)), 20), " "), 256).alias("context"))


@query(
    "with t as (select o_orderkey as id, unnest(range(0, 6)) as i from orders), s as (select id, i, i * 5 as a, i * 5 + 4 as b, id % 7 as x, id % 7 + 9 as y from t) select id, string_agg(case when a < y and b > x then case when not (i > 0 and a - 5 < y and b - 5 > x) then 'B-ASP' else 'I-ASP' end else 'O' end, ',' order by i) as labels from s group by 1"
)
def aligned_bio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six tokens of four characters against a span of nine."""
    offsets = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.struct((i * 5).alias("start_char"), (i * 5 + 4).alias("end_char")))
    span = F.array(F.struct((F.col("o_orderkey") % 7).cast("int").alias("start_char"), (F.col("o_orderkey") % 7 + 9).cast("int").alias("end_char")))
    return fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(spans.align_bio(offsets, span), ",").alias("labels"))


@query("with t as (select o_orderkey as id, [o_orderkey % 11, o_orderkey % 7 * 3, o_orderkey % 5 * 5] as a from orders) select id, abs(a[1] - a[2]) < 4 or abs(a[1] - a[3]) < 4 or abs(a[2] - a[3]) < 4 as overlaps from t")
def overlapping_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = [F.col("o_orderkey") % 11, F.col("o_orderkey") % 7 * 3, F.col("o_orderkey") % 5 * 5]
    three = F.array(*(F.struct(a.cast("int").alias("start_char"), (a + 4).cast("int").alias("end_char")) for a in at))
    return fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), spans.overlapping(three).alias("overlaps"))


@query(f"with {fx.MENTIONS_SQL}, g as (select case when l_suppkey % 17 <> 0 then aspect_id else 'unknown' end as gold, case when roll = 3 then 'unknown' when roll = 4 then 'price' else aspect_id end as predicted from m) select gold as label, count_if(gold = predicted)::bigint as correct, count(*) as total, round(count_if(gold = predicted) / count(*), 9) as recall from g group by 1")
def normalization_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.mentions(spark, sf_dir, unknowns=True)
    known = F.element_at(fx.id_array(), (F.col("aspect_ix") + 1).cast("int"))
    return metrics.normalization_recall(rows.select(F.col("aspect_id").alias("gold"), F.when(F.col("roll") == 4, "price").when(F.col("roll") != 3, known).alias("predicted")))


@query(f"with {fx.MENTIONS_SQL}, g as (select case when l_suppkey % 17 <> 0 then aspect_id else 'unknown' end as gold, case when roll = 3 then 'unknown' when roll = 4 then 'price' else aspect_id end as predicted from m) select round(count_if(gold = predicted) / count(*), 9) as accuracy, count_if(gold = 'unknown' and predicted <> 'unknown')::bigint as false_known, count(*) as examples from g")
def normalization_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.mentions(spark, sf_dir, unknowns=True)
    known = F.element_at(fx.id_array(), (F.col("aspect_ix") + 1).cast("int"))
    return metrics.normalization_metrics(rows.select(F.col("aspect_id").alias("gold"), F.when(F.col("roll") == 4, "price").when(F.col("roll") != 3, known).alias("predicted")))


_GATES = f"""{fx.MENTIONS_SQL}, g as (select sentiment as gold, case when roll % 4 <> 0 then sentiment else 'neutral' end as predicted from m), s as (select (count_if(gold = predicted) / count(*)) as f1 from g),
k as (select l, count_if(gold = l) as n, count_if(predicted = l) as q, count_if(gold = l and predicted = l) as tp from g, (select unnest(['positive', 'neutral', 'negative']) as l) group by 1),
c as (select avg(2 * tp / (n + q)) as f, min(tp / n) as r from k)"""


@query(f"with {_GATES} select x.gate, case x.gate when 'span_f1' then s.f1 >= 0.7 when 'span_f1_above_rules' then s.f1 > 0.36719286204529855 when 'macro_f1' then c.f >= 0.65 when 'every_recall' then c.r >= 0.5 else c.f > 0.6173789003975411 end as passed from s, c, (select unnest(['span_f1', 'span_f1_above_rules', 'macro_f1', 'every_recall', 'macro_f1_above_tfidf']) as gate) x")
def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.mentions(spark, sf_dir).select(F.col("sentiment").alias("gold"), F.when(F.col("roll") % 4 != 0, F.col("sentiment")).otherwise("neutral").alias("predicted"))
    return metrics.gates(rows.agg(F.avg((F.col("gold") == F.col("predicted")).cast("int")).alias("f1")), metrics.class_metrics(rows))


@query("select 'lang' as \"column\", lang as value, count(*) as rows from documents group by 2 union all select 'source', source, count(*) from documents group by 2 union all select 'quality', quality::varchar, count(*) from documents join labels using (doc_id) group by 2")
def dataset_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents")
    both = metrics.dataset_statistics(docs, ["lang", "source"])
    return both.unionByName(metrics.dataset_statistics(docs.join(fx.table(spark, sf_dir, "labels"), "doc_id"), ["quality"]))


@query(f"with {fx.MENTIONS_SQL} select product_id, aspect_id, label, reviews, row_number() over (partition by product_id order by reviews desc, lower(label), label) as shown from (select product_id, aspect_id, {fx.LABELS_SQL}[aspect_id] as label, count(*) as reviews from m group by 1, 2) where contains(lower(label), 'e')")
def shown_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.mentions(spark, sf_dir).groupBy("product_id", "aspect_id").agg(F.count("*").alias("review_count")).withColumn("label", ontology.label_of(F.col("aspect_id")))
    return serving.shown_aspects(rows, "E").select("product_id", "aspect_id", "label", F.col("review_count").alias("reviews"), "shown")


@query(f"with {fx.VOTES_SQL}, r as (select product_id, aspect_id, review_id, row_number() over (partition by product_id, aspect_id order by review_id) as place from v where vote = 'negative') select * from r where place <= 5")
def shown_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.shown_reviews(votes.votes(fx.mentions(spark, sf_dir)), ["review_id"], "negative").select("product_id", "aspect_id", "review_id", "place")


@query(f"with {fx.ASPECTS_SQL} select product_id, count(*) as aspects, count_if(review_count >= 3 and classification in ('good', 'excellent'))::bigint as strengths, count_if(review_count >= 3 and classification in ('weak', 'poor'))::bigint as complaints from a group by 1")
def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.highlights(votes.product_ranking(fx.mentions(spark, sf_dir)))


@query("select o_orderkey, o_custkey from orders order by o_orderdate desc, o_orderkey limit 20 offset 40")
def third_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.page(fx.table(spark, sf_dir, "orders"), [F.desc("o_orderdate"), "o_orderkey"], 3).select("o_orderkey", "o_custkey")


@query("select o_custkey, o_orderkey, ((row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1) // 20)::int + 1 as page from orders")
def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.pages(fx.table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "page")


@query("select c_custkey from customer where contains(lower(c_name), '00')")
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "customer").where(validation.contains_folded(F.col("c_name"), F.lit("00"))).select("c_custkey")


@query(f"with {fx.MENTIONS_SQL} select review_id, l_linenumber, l_suppkey, l_partkey, l_suppkey % 17 = 0 or confidence < 0.6::double as uncertain from m")
def uncertain_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.mentions(spark, sf_dir, unknowns=True)
    tag = F.struct(F.col("aspect_id").alias("normalized_aspect_id"), "confidence")
    return rows.select("review_id", "ordinal.l_linenumber", "ordinal.l_suppkey", "ordinal.l_partkey", reports.uncertain(tag).alias("uncertain"))


@query(f"with {fx.MENTIONS_SQL} select product_id, review_id, aspect_id, sentiment, confidence from m")
def saved_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.checked(fx.mentions(spark, sf_dir)).select("product_id", "review_id", "aspect_id", "sentiment", "confidence")


@query("select distinct o_orderkey as review_id, o_custkey as product_id from orders")
def unique_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every review given twice."""
    rows = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("review_id"), F.col("o_custkey").alias("product_id"))
    return votes.unique_reviews(rows.unionByName(rows))


@query(f"with {fx.MENTIONS_SQL}, g as (select product_id, aspect_id, sentiment, count(*) as mentions from m group by all) select product_id, aspect_id, sentiment, mentions, row_number() over (partition by product_id order by mentions desc, aspect_id) as place from g where sentiment = 'negative'")
def legacy_weaknesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.mentions(spark, sf_dir).withColumn("tag", ontology.tag_of(F.col("aspect_id"), F.col("sentiment")))
    return votes.legacy_ordered(votes.legacy_aggregate(rows), "negative").select("product_id", "aspect_id", "sentiment", "mentions", "place")


_DIGEST_SQL = (
    f"with {fx.ASPECTS_SQL}, h as (select v.*, floor(o_totalprice)::bigint % 50 as hv from v join orders on review_id = o_orderkey), "
    "rp as (select *, row_number() over (partition by product_id, aspect_id, vote order by confidence desc, hv desc, review_id) as place from h), n as (select o_custkey % 400 as product_id, count(distinct o_orderkey) as review_count from orders group by 1), "
    "s as (select product_id, count(*) as aspects, string_agg(case when classification in ('excellent', 'good') then aspect_id end, ',' order by rank) as strengths, string_agg(case when classification in ('poor', 'weak') then aspect_id end, ',' order by rank) as weaknesses, string_agg(case when rank <= 10 then aggregate_tag end, ',' order by rank) as top_tags from a group by 1), "
    "d as (select product_id, count_if(vote = 'positive')::bigint as positive, count_if(vote = 'negative')::bigint as negative from v group by 1), q as (select product_id, count(*) as chosen, sum(review_id)::bigint as chosen_ids from rp where place <= 3 group by 1) "
    "select n.product_id, review_count, coalesce(positive, 0) as positive, coalesce(negative, 0) as negative, coalesce(aspects, 0)::int as aspects, coalesce(strengths, '') as strengths, coalesce(weaknesses, '') as weaknesses, coalesce(top_tags, '') as top_tags, coalesce(chosen, 0)::int as chosen, coalesce(chosen_ids, 0) as chosen_ids from n left join s using (product_id) left join d using (product_id) left join q using (product_id)"
)


def _digest(rows: DataFrame) -> DataFrame:
    """What nested snapshots say, in plain columns."""
    ids = F.transform("representative_reviews", lambda r: r["review_id"])
    joined = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return rows.select(
        "product_id", "review_count", "positive", "negative", F.coalesce(F.size("aspects"), F.lit(0)).alias("aspects"), joined("strengths_aspects").alias("strengths"), joined("weaknesses_aspects").alias("weaknesses"),
        joined(F.transform("top_tags", lambda t: t["aggregate_tag"])).alias("top_tags"), F.coalesce(F.size(ids), F.lit(0)).alias("chosen"), F.coalesce(F.aggregate(ids, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0)).alias("chosen_ids"),
    )


@query(_DIGEST_SQL)
def snapshot_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(votes.snapshot(fx.mentions(spark, sf_dir), fx.reviews(spark, sf_dir)))


def published(spark: SparkSession, sf_dir: str, epochs: int = 4) -> DataFrame:
    """The current snapshots after some epochs of new reviews, partials merged into a base on the way."""
    rows = fx.analyses(spark, sf_dir)
    path = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"
    for epoch in range(epochs):
        publish.publish_batch(rows.where(F.col("review_id") % epochs == epoch), path, epoch, buckets=4, every=2)
    return publish.current(spark.read.parquet(f"{path}/snapshots"))


@query(_DIGEST_SQL)
def published_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four epochs of publication say what one pass over all mentions says."""
    return _digest(published(spark, sf_dir))


@query("with p as (select conv_id, text from conversations where role = 'user' and text is not null), q as (select conv_id, turn, text from conversations where text is not null) select c.conv_id, c.turn, trim(substr(c.text, 3, 12)) <> '' and c.turn % 4 <> 3 as valid from q c where length(c.text) > 2 and c.turn % 5 <> 4 union all select conv_id, turn, false from q where length(text) > 2 and turn % 5 = 4")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of turns: every fourth altered, every fifth of a turn that was not retrieved."""
    rows = _said(spark, sf_dir).where("length(text) > 2").withColumn("review_id", F.col("turn"))
    quote = F.concat(F.substring("text", 3, 12), F.when(F.col("turn") % 4 == 3, "\u0001").otherwise(""))
    return retrieval.cited(rows.select("conv_id", "turn", "review_id", quote.alias("quote")), rows.where("turn % 5 <> 4").select("conv_id", "review_id", "text"), ["conv_id"]).select("conv_id", "turn", "valid")


@query("select o_orderkey as id, case when o_orderkey % 4 >= o_orderkey % 3 then '0-7' else '2-9' end || ',10-14' as kept from orders")
def merged_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping candidates, of which the one farther from its window's edge stays, and one of its own."""
    candidate = lambda a, b, c, m: F.struct(F.lit(a).alias("start_char"), F.lit(b).alias("end_char"), F.lit(c).alias("confidence"), m.cast("int").alias("boundary_margin"), F.lit(0).alias("window_index"))
    k = F.col("o_orderkey")
    found = sentiment.merge_windows(F.lit("battery life x y"), F.array(candidate(0, 7, 0.9, k % 4), candidate(2, 9, 0.8, k % 3), candidate(10, 14, 0.5, F.lit(2))))
    return fx.table(spark, sf_dir, "orders").select(k.alias("id"), F.array_join(F.transform(found, lambda s: F.concat_ws("-", s["start_char"].cast("string"), s["end_char"].cast("string"))), ",").alias("kept"))


@query()
def captured_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of all pages, the first of each text; tested by hand-written pages."""
    from ..sources import imports

    return imports.captured(fx.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("url"), "html")).select("url", "ordinal", F.sha2("review_text", 256).alias("text"))
