"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroid_clustering, embedding_dedup, html_extraction, language_id, mixing, ngram_join, packing, periodic_runs, quality_pu, quality_rules, substring_dedup, toxicity, url_filter
from .learning import fold
from .runtime import WORD, cut, table

Query = Callable[[SparkSession, str], DataFrame]


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, url_filter.outcomes_from_labels(pages, table(spark, sf_dir, "labels")))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def _judged(scored: DataFrame, folds: int, held: int) -> DataFrame:
    return scored.withColumn("held_out", fold("doc_id", folds) == held)


def op6_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learnt = quality_pu.fit(docs.where(fold("doc_id", 5) != 0), labels.where(fold("doc_id", 5) != 0))
    scored = _judged(quality_pu.score(docs, learnt), 5, 0)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learnt = language_id.fit(docs.where(fold("doc_id", 4) != 2))
    return _judged(language_id.predict(docs, learnt), 4, 2).select("doc_id", "held_out", "lang_pred", "score", F.size("mixture").alias("n_languages"))


def op8_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    train = docs.where(fold("doc_id", 5) != 0)
    languages = language_id.fit(train)
    known = labels.where(fold("doc_id", 5) != 0)
    fitted = toxicity.fit_weights(train, known)
    if fitted is None:
        scored = toxicity.score(docs, None, languages)
    else:  # one pass over the texts, for the thresholds (training rows only) and for the scores
        net, used = fitted
        seen = cut(toxicity.logits(docs, net, languages))
        toxicity.calibrate(net, seen.where(fold("doc_id", 5) != 0), known, used, languages)
        scored = toxicity.shifted(seen, net, languages)
    scored = _judged(scored, 5, 0)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op9_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reasons")


def op11_drake_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, centres = centroid_clustering.cluster(table(spark, sf_dir, "embeddings"))
    placed = cut(placed)
    inertia = {r.cluster: int(r.inertia) for r in placed.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # k rows
    rows = [(c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centres.tolist())]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_dom_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    model = html_extraction.fit(pages, table(spark, sf_dir, "documents"))
    return html_extraction.extract(pages, model).select("page_id", "url", "text", "n_chars")


def with_periods(docs: DataFrame) -> DataFrame:
    """documents, a tenth of them (by crc32 of the id) with words from a place on that repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    split = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), 0))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), split.alias("w")).withColumn("n", F.size("w"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    words = F.expr("transform(sequence(0, n - 1), i -> get(w, int(if(i < a, i, a + (i - a) % p))))")
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapse(with_periods(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    found = found.withColumns({"longest": longest, "listed": F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")})
    length, period = F.col("longest.length"), -F.col("longest.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2("listed", 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op9 that SQL can express: what each source shall give."""
    rows = mixing.sample(table(spark, sf_dir, "documents"))
    return rows.groupBy("source", "source_size").agg(F.round(F.first("target"), 3).alias("target"), F.count("*").alias("documents"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op10 that SQL can express: counts and base rule."""
    counts = quality_rules.features(table(spark, sf_dir, "documents"))
    return counts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality_rules.base_failed().alias("base_failed"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op3 that SQL can express: hosts, paths and rules."""
    return op3_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


QUERIES: dict[str, Query] = {
    "mixing_targets": mixing_targets,
    "quality_counts": quality_counts,
    "url_rules": url_rules,
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_pattern_packing": op5_pattern_packing,
    "op6_quality_pu": op6_quality_pu,
    "op7_language_mixture": op7_language_mixture,
    "op8_toxicity_cnn": op8_toxicity_cnn,
    "op9_systematic_mixing": op9_systematic_mixing,
    "op10_quality_rules": op10_quality_rules,
    "op11_drake_kmeans": op11_drake_kmeans,
    "op12_dom_marginals": op12_dom_marginals,
    "op13_periodic_runs": op13_periodic_runs,
}

# Plain rounds: all distances of the vectors to the centroids, then floored means; a and c by round.
KMEANS_ROUND = """
a{0} as materialized (select r, any_value(v.v) as v, arg_min(c, (list_dot_product(v.d, v.d) + list_dot_product(k.d, k.d) - 2 * list_dot_product(v.d, k.d), c)) as c from v cross join c{0} k group by r),
e{0} as (select c, unnest(v) as x, unnest(range(64)) as p from a{0}), s{0} as (select c, p, sum(x)::bigint as s, count(*) as n from e{0} group by c, p),
m{0} as (select c, list((s - ((s % n) + n) % n) // n order by p) as v from s{0} group by c),
c{1} as materialized (select c, coalesce(m.v, k.v) as v, coalesce(m.v, k.v)::double[] as d from c{0} k left join m{0} m using (c)),
"""

ORACLES: dict[str, str] = {
    "mixing_targets": r"""
with d as (select source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as n from documents),
s as (select source, sum(n)::bigint as source_size, count(*) as documents, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w from d group by 1),
t as (select 1.5::double * sum(source_size) as total from s),
-- Every cap that may be the last one met gives a level; the right one is where capped and free parts add up.
l as (select a.source as last, (any_value(total) - coalesce(sum(2 * b.source_size) filter (where 2 * b.source_size / b.w < 2 * a.source_size / a.w), 0)) / sum(b.w) filter (where 2 * b.source_size / b.w >= 2 * a.source_size / a.w) as level, any_value(2 * a.source_size / a.w) as own from s a, s b, t group by a.source),
m as (select coalesce(arg_min(level, own) filter (where own >= level), 1e300) as level from l)
select source, source_size, documents, round(least(2.0::double * source_size, level * w), 3) as target from s, m
""",
    "quality_counts": r"""
with d as (select doc_id, coalesce(text, '') as t from documents), w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from d),
n as (select doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x : length(x))), 0)::bigint as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  list_filter(string_split(t, chr(10)), lambda x : regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from w),
g as (select doc_id, unnest(range(1, len(w) - 1)) as p, w from w where len(w) >= 3), k as (select doc_id, p, array_to_string(w[p : p + 2], ' ') as g from g),
r as (select doc_id, p from (select doc_id, p, count(*) over (partition by doc_id, g) as c from k) where c > 1),
c as (select doc_id, count(*) as covered from (select distinct doc_id, unnest([p, p + 1, p + 2]) as q from r) group by 1)
select doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(covered, 0)::bigint as n_repeat_words,
  n_words < 50 or 100 * coalesce(covered, 0) > 50 * n_words as base_failed from n left join c using (doc_id)
""",
    "url_rules": r"""
with u as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end as r from pages),
h as (select page_id, coalesce(translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host, coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') as path from u),
m as (select h.*, v.rule, v.verdict, row_number() over (partition by page_id order by length(v.rule) desc) as n from h left join (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) v0(host, path, verdict)
  on (h.host = v0.host or ends_with(h.host, '.' || v0.host)) and starts_with(h.path, v0.path) left join (select 1) on true cross join lateral (select v0.host || v0.path as rule, v0.verdict as verdict) v)
select page_id, host, path, rule, verdict as ruled from m where n = 1
""",
    "op1_embedding_dedup": """
with recursive e as (select vec_id, list_transform(embedding, lambda x : x::double) as v from embeddings),
n as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x : x * x))) as l from e),
links as materialized (
  select a.vec_id as x, b.vec_id as y from n a join n b on a.vec_id <> b.vec_id
  where a.l > 0 and b.l > 0 and list_dot_product(a.v, b.v) / (a.l * b.l) >= 0.95),
reach as (select vec_id as x, vec_id as y from e union select r.x, l.y from reach r join links l on r.y = l.x),
c as (select x as vec_id, min(y) as component_id from reach group by x),
d as (select x as vec_id, count(*) as n_links from links group by x)
select c.vec_id, coalesce(d.n_links, 0)::bigint as n_links, c.component_id, c.vec_id = c.component_id as kept from c left join d using (vec_id)
""",
    "op4_ngram_jaccard": r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, g from (
  select doc_id, array_to_string(w[p : p + 4], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as p from d where len(w) >= 5)
  union all select doc_id, array_to_string(w, ' ') from d where len(w) between 1 and 4)),
n as (select doc_id, count(*) as n from s group by doc_id),
links as materialized (
  select a.doc_id as x, b.doc_id as y from s a join s b on a.g = b.g and a.doc_id <> b.doc_id join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  group by a.doc_id, b.doc_id having 100 * count(*) >= 75 * (any_value(na.n) + any_value(nb.n) - count(*))),
reach as (select doc_id as x, doc_id as y from d union select r.x, l.y from reach r join links l on r.y = l.x)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(r.y) as component_id
from d left join n using (doc_id) join reach r on r.x = d.doc_id group by d.doc_id, n.n
""",
    "op2_substring_dedup": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, unnest(range(1, len(w) - 11)) as p, w from d where len(w) >= 13),
keyed as (select doc_id, p, array_to_string(w[p : p + 12], ' ') as g from win),
firsts as (select g, min(doc_id) as first_doc from keyed group by g),
gone as (select distinct k.doc_id, unnest(range(k.p, k.p + 13)) as q from keyed k join firsts f using (g) where k.doc_id > f.first_doc),
pos as (select doc_id, unnest(range(1, len(w) + 1)) as q, w from d),
kept as (select p.doc_id, string_agg(p.w[p.q], ' ' order by p.q) as t, count(*) as n from pos p anti join gone g on p.doc_id = g.doc_id and p.q = g.q group by p.doc_id)
select d.doc_id, len(d.w)::bigint as n_words, (len(d.w) - coalesce(k.n, 0))::bigint as n_removed, sha256(coalesce(k.t, '')) as kept_sha256
from d left join kept k using (doc_id)
""",
    # crc32 bit by bit over the digits; then words equal q apart, in islands of at least 3 q; the smallest period is the one that no other divides.
    "op13_periodic_runs": r"""
with c as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
  xor(list_reduce([4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda x : ascii(x)::bigint),
    lambda a, b : list_reduce([xor(a, b)] || range(8), lambda e, z : xor(e >> 1, (e & 1) * 3988292384))), 4294967295) as h from documents),
g as (select doc_id, w, len(w) as n, h % 10 = 0 and len(w) > 0 as planted, h // 10 as g from c),
a as (select *, case when planted then g % n end as a from g), p as (select *, 1 + (n - a) // (3 + g % 8) as p from a),
d as (select doc_id, n, case when planted then list_transform(range(n), lambda i : w[case when i < a then i else a + (i - a) % p end + 1]) else w end as w from p),
t as (select doc_id, n, unnest(range(n)) as i, unnest(w) as x from d),
s as (select x.doc_id, y.i - x.i as q, x.i from t x join t y on x.doc_id = y.doc_id and x.x = y.x and y.i > x.i and y.i - x.i <= x.n // 4),
o as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as island from s),
m as (select doc_id, q as period, min(i) as start, count(*) + q as length from o group by doc_id, q, island having count(*) + q >= greatest(6, 4 * q)),
r as (select * from m where not exists (select 1 from m k where k.doc_id = m.doc_id and k.period < m.period and m.period % k.period = 0 and k.start <= m.start and k.start + k.length >= m.start + m.length)),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from r),
kept as (select t.doc_id, string_agg(t.x, ' ' order by t.i) as k from t anti join gone on t.doc_id = gone.doc_id and t.i = gone.i group by t.doc_id),
l as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as listed, arg_min({'s': start, 'l': length, 'p': period}, (-length, start, period)) as b from r group by doc_id)
select d.doc_id, coalesce(n_runs, 0)::bigint as n_runs, b.s::bigint as start, b.l::bigint as length, b.p::bigint as period, (1000 * b.l // b.p)::bigint as exponent_milli, sha256(coalesce(listed, '')) as runs_sha256, sha256(coalesce(k, '')) as collapsed_sha256
from d left join l using (doc_id) left join kept using (doc_id)
""",
    "op11_drake_kmeans": """
with w as (select vec_id, list_transform(embedding, lambda x : floor(256 * x::double)::bigint) as v from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x : isfinite(x))) = 64),
v as materialized (select vec_id, row_number() over () as r, v, v::double[] as d from w),
c0 as materialized (select row_number() over (order by sha256('2:' || vec_id)) - 1 as c, v, d from v qualify c < 40),
"""
    + "".join(KMEANS_ROUND.format(i, i + 1) for i in range(5))
    + """
d as (select r, vec_id, (list_dot_product(v.d, v.d) + list_dot_product(k.d, k.d) - 2 * list_dot_product(v.d, k.d))::bigint as distance, c, k.v as centre from v cross join c5 k),
n as (select r, any_value(vec_id) as vec_id, arg_min(c, (distance, c)) as cluster, min(distance) as distance, arg_min(centre, (distance, c)) as centre from d group by r)
select vec_id, cluster::int as cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia, sha256(array_to_string(centre, ',')) as centroid_sha256 from n
""",
}
