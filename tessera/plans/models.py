"""Queries of the model hooks, with deterministic stand-ins for the models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grams, models, ontology, sentiment
from ..operators import retrieval
from ..session import cut, dealt
from . import fixtures as fx
from .registry import query

_LOGITS = "list_transform(embedding[1:3], lambda x : exp(x::double * 10 - list_max(embedding[1:3])::double * 10))"


@query(f"with e as (select vec_id, {_LOGITS} as x from embeddings) select vec_id, ['negative', 'neutral', 'positive'][list_position(x, list_max(x))] as label, round(list_max(x) / list_sum(x), 6) as confidence, round(x[1] / list_sum(x), 6) as negative from e")
def labelled_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double") * 10)
    s = models.labelled(z, ("negative", "neutral", "positive"))
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", s["label"].alias("label"), F.round(s["confidence"], 6).alias("confidence"), F.round(s["probabilities"]["negative"], 6).alias("negative"))


@query(
    "with e as (select vec_id, list_transform(range(1, 5), lambda i : (embedding[i]::double + case when vec_id % 2 = 1 then embedding[i + 4]::double else 0 end + embedding[i + 8]::double) / (2 + vec_id % 2)) as m from embeddings), n as (select vec_id, m, sqrt(list_sum(list_transform(m, lambda x : x * x))) as l from e) "
    "select vec_id, round(m[1] / l, 6) as a, round(m[4] / l, 6) as b from n"
)
def pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tokens of four numbers, the second one masked in every other row."""
    v = models.mean_pooled(F.array(*(F.slice("embedding", 1 + 4 * i, 4) for i in range(3))), F.array(F.lit(1), (F.col("vec_id") % 2).cast("int"), F.lit(1)))
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("a"), F.round(F.get("v", F.lit(3)), 6).alias("b"))


@query(f"with {fx.REVIEWS_SQL} select review_id, ordinal, normalized_aspect_id as label, 'semantic' as method from rm")
def encoded_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct phrases encoded once by the stand-in encoder; the nearest alias is the phrase itself."""
    encode = models.encoder(models.stub_encoder(64))
    prototypes = ontology.aliases(spark).select(F.col("aspect_id").alias("label"), encode(F.col("alias")).alias("vector"))
    rows = fx.review_texts(spark, sf_dir).select("review_id", F.posexplode(sentiment.extract_aspects(F.col("review_text"))).alias("ordinal", "a")).select("review_id", "ordinal", F.col("a.raw_aspect").alias("phrase"))
    found = retrieval.nearest(retrieval.distinct_encoded(rows.select("phrase").distinct().withColumn("id", F.col("phrase")), "phrase", encode).select("id", "vector"), prototypes, 0.999)
    return rows.join(found, rows["phrase"] == found["id"]).select("review_id", "ordinal", "label", "method")


def _tagger():
    """Tokens of six letters and more are aspects; those that follow one continue it."""
    import numpy as np

    def predict(tokens: list[str]) -> np.ndarray:
        long = np.array([len(t) >= 6 for t in tokens], bool)
        before = np.concatenate([[False], long[:-1]])
        at = np.where(~long, 0, np.where(before, 2, 1))
        return np.eye(3)[at] * 5

    return predict


_WINDOWED = """t as (select doc_id, string_split(text, ' ') as w from documents where text is not null and length(text) < 1500), x as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from t),
f as (select doc_id, i, length(w[i]) >= 6 as is_long, i > 1 and length(w[greatest(i - 1, 1)]) >= 6 as before, i < len(w) and length(w[least(i + 1, len(w))]) >= 6 as follows from x)"""


@query(f"with {_WINDOWED}, s as (select doc_id, count_if(is_long and not before)::int as n from f group by 1) select doc_id, n from s")
def tagged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many runs the stand-in token classifier finds in short documents."""
    from ..operators import spans

    label = models.token_classifier(lambda: _tagger(), ("O", "B-ASP", "I-ASP"))
    rows = fx.table(spark, sf_dir, "documents").where("text is not null and length(text) < 1500").select("doc_id", label(F.split("text", " ", -1)).alias("p"))
    return rows.select("doc_id", F.size(spans.bio_runs(F.transform("p", lambda x: x["label"]), True)).alias("n"))


def _stub():
    def generate(system: str, payload: dict, schema: dict) -> dict:
        kind = payload["kind"]
        if kind % 5 == 4:
            raise TimeoutError("no answer")
        if payload["task"] == "suggest":
            return {"canonical_aspect_id": [None, "battery", "nope", None][kind % 4], "proposed_aspect_label": [" Hinge ", None, None, "  "][kind % 4], "explanation": "why" if kind % 7 else " "}
        if payload["task"] == "answer":
            quote = payload["text"][:10] if kind % 3 else "never said this"
            return {"claims": [{"text": "a claim", "citations": [{"review_id": payload["review"], "quote": quote}]}] if kind % 4 else []}
        ids = payload["ids"]
        return {"features": [{"aspect_id": i, "takeaway": "fine"} for i in (ids if kind % 3 else ids[::-1])]}

    return generate


def _asked(rows: DataFrame, payload: Column, system: str) -> DataFrame:
    g = models.generated(payload, system, {"type": "object"}, lambda: _stub())
    return rows.withColumn("g", g).withColumn("output", F.col("g.output"))


@query(
    f"with {fx.REVIEWS_SQL}, k as (select *, review_id % 60 as n from rm) select review_id, ordinal, case when n % 5 = 4 then 'fields' when n % 7 = 0 then 'explanation' when n % 4 = 2 then 'canonical_id' end as error, case when n % 5 <> 4 and n % 7 <> 0 and n % 4 = 1 then 'battery' end as canonical_aspect_id, "
    "case when n % 5 <> 4 and n % 7 <> 0 and n % 4 = 0 then 'Hinge' end as proposed_aspect_label from k"
)
def aspect_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentiment.analyze(fx.review_texts(spark, sf_dir)).select("review_id", "review_text", "ordinal", "raw_aspect", "start_char", "end_char")
    payload = F.to_json(F.struct(F.lit("suggest").alias("task"), (F.col("review_id") % 60).alias("kind"), "raw_aspect"))
    got = models.suggestions(_asked(rows, payload, "Classify the phrase."))
    return got.select("review_id", "ordinal", "error", "canonical_aspect_id", "proposed_aspect_label")


@query(
    "with u as (select conv_id, turn, text from conversations where text is not null and length(text) > 20 and turn = 1) select conv_id, case when conv_id % 5 = 4 then 'invalid' when conv_id % 4 = 0 then 'insufficient_evidence' when conv_id % 3 = 0 then 'invalid' else 'answered' end as status, "
    "case when conv_id % 5 <> 4 and conv_id % 4 <> 0 and conv_id % 3 <> 0 then 1 else 0 end as claims from u"
)
def cited_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = fx.table(spark, sf_dir, "conversations").where("text is not null and length(text) > 20 and turn = 1").select("conv_id", F.concat(F.lit("r"), F.col("conv_id").cast("string")).alias("review_id"), "text")
    payload = F.to_json(F.struct(F.lit("answer").alias("task"), F.col("conv_id").alias("kind"), F.col("review_id").alias("review"), "text"))
    got = models.answers(_asked(u, payload, "Answer from the reviews."), u, "conv_id")
    return got.select("conv_id", "status", F.coalesce(F.size("claims"), F.lit(0)).alias("claims"))


@query("select c_custkey, case when c_custkey % 5 = 4 or c_custkey % 3 = 0 then 'features' end as error, case when c_custkey % 5 <> 4 and c_custkey % 3 <> 0 then 2 else 0 end as takeaways from customer")
def feature_takeaways(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "customer").select("c_custkey", F.array(F.lit("battery"), F.lit("price")).alias("aspect_ids"))
    payload = F.to_json(F.struct(F.lit("features").alias("task"), F.col("c_custkey").alias("kind"), F.col("aspect_ids").alias("ids")))
    got = models.takeaways(_asked(rows, payload, "One takeaway a feature."))
    return got.select("c_custkey", "error", F.coalesce(F.size("takeaways"), F.lit(0)).alias("takeaways"))


@query("select c_custkey, case when c_custkey % 4 = 0 then 'evidence' when c_custkey % 4 = 1 then 'summary' when c_custkey % 4 = 2 then 'trade_off' end as error, case when c_custkey % 4 = 3 then c_name end as summary from customer")
def comparison_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    output = F.to_json(F.struct(F.when(k == 1, "").otherwise(F.col("c_name")).alias("summary"), F.when(k == 2, F.repeat(F.lit("x"), F.lit(601))).otherwise("more").alias("trade_off")))
    rows = fx.table(spark, sf_dir, "customer").select("c_custkey", (k == 0).alias("blocked"), F.lit(2).alias("supported_features"), output.alias("output"))
    return models.explanations(rows).select("c_custkey", "error", "summary")


@query(
    "with d as (select doc_id, text from documents where text is not null) select doc_id::varchar as path, case when doc_id % 9 = 0 then 'missing' when doc_id % 9 = 1 then 'pointer' when doc_id % 9 = 2 then 'unlisted' when doc_id % 9 = 3 then 'hash' end as \"check\" from d where doc_id % 9 < 4 union all select 'config.json', 'missing'"
)
def checkpoint_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a checkpoint's files, spoilt in four ways; its configuration is not there."""
    d = fx.table(spark, sf_dir, "documents").where("text is not null").withColumn("path", F.col("doc_id").cast("string"))
    k = F.col("doc_id") % 9
    pointer = F.concat(F.lit(models.POINTER.decode()), F.col("path"))
    files = d.where(k != 0).select("path", F.encode(F.when(k == 1, pointer).otherwise(F.col("text")), "utf-8").alias("content"))
    manifest = d.where(k != 2).select("path", F.sha2(F.encode(F.when(k == 3, F.concat("text", F.lit("x"))).otherwise(F.col("text")), "utf-8"), 256).alias("sha256"))
    return models.checkpoint_files(files, manifest, ["config.json"])


# Fixed value: as how many lines a document counts where tables are dealt to tasks.
LINES_OF_TEXT = 8


@query()
def tfidf_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and hits, by split, of the TF-IDF baseline trained on four fifths of the labelled documents' quality."""
    docs, labels = fx.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"), fx.table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs, labels = dealt(LINES_OF_TEXT * docs.count(), (docs, "doc_id"), (labels, "doc_id"))
    known = docs.join(labels.hint("shuffle_hash"), "doc_id")  # texts meet their labels once, and are not sorted for it
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    rows = cut(known.select("text", F.col("quality").cast("string").alias("label"), held_out.alias("held_out")))
    common = grams.common(rows.where("not held_out"), most=20_000)
    vectors = cut(grams.damped(rows, common).drop("text"))  # of both splits, made once
    fitted = models.tfidf_regression(vectors.where("not held_out"), common, iterations=20)
    got = fitted.predicted(vectors).select("held_out", (F.col("predicted") == F.col("label")).alias("hit"))
    return got.groupBy("held_out").agg(F.count("*").alias("rows"), F.count_if("hit").alias("hits"))
