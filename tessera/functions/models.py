"""Hooks for models, and all around them that is data: pooling, softmax, prompts' schemas, checks of outputs.

A model is a `load` function that an executor calls once per task and that returns a batch function; no
weights are shipped here. `generate(system, payload, schema)` returns a dict. Outputs are checked as columns:
a row whose output is not valid gets an `error`, and the others their result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import grams as gram
from . import ontology
from .text import slice_text

Encode = Callable[[Sequence[str]], np.ndarray]
Generate = Callable[[str, dict, dict], dict]


def softmax(logits: Column) -> Column:
    """array<double>; the largest logit is taken off first, so that none overflows."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp((x - top).cast("double")))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def argmax(values: Column) -> Column:
    """Place, from 0, of the first of the largest values; null for an empty array."""
    return F.when(F.size(values) > 0, (F.array_position(values, F.array_max(values)) - 1).cast("int"))


def labelled(logits: Column, labels: Sequence[str]) -> Column:
    """struct<label, confidence, probabilities> of a row of logits."""
    p = softmax(logits)
    at = argmax(p)
    names = F.array(*(F.lit(x) for x in labels))
    return F.struct(F.get(names, at).alias("label"), F.get(p, at).alias("confidence"), F.map_from_arrays(names, p).alias("probabilities"))


def mean_pooled(vectors: Column, mask: Column) -> Column:
    """The mean of the token vectors that the mask keeps, scaled to length 1 (zeros where nothing is kept)."""
    kept = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda t: t["m"] > 0)
    none = F.transform(F.get(vectors, F.lit(0)), lambda _: F.lit(0.0))
    total = F.aggregate(kept, none, lambda a, t: F.zip_with(a, t["v"], lambda x, y: x + y.cast("double")))
    mean = F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))
    norm = F.sqrt(F.aggregate(mean, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(mean, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def encoder(load: Callable[[], Encode]) -> Callable[[Column], Column]:
    """A column function that encodes texts in batches; null texts have no vector. Use it on distinct phrases."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in parts:
            some = texts.notna().to_numpy()
            out = pd.Series([None] * len(texts), dtype=object)
            if some.any():
                for i, v in zip(np.flatnonzero(some), np.asarray(encode(texts[some].tolist()), float), strict=True):
                    out[i] = v.tolist()
            yield out

    return run


def token_classifier(load: Callable[[], Callable[[list[str]], np.ndarray]], labels: Sequence[str]) -> Callable[[Column], Column]:
    """A column function from a window's tokens to array<struct<label, confidence>>; `load()` maps tokens to
    (tokens, labels) logits."""

    @F.arrow_udf("array<struct<label:string,confidence:double>>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predict = load()
        names = pa.array(list(labels), pa.string())
        for windows in parts:
            at, sure, sizes = [], [], [0]
            for window in windows:  # a window's tokens are Python's one window at a time
                tokens = window.as_py() or []
                z = np.asarray(predict(tokens), float).reshape(len(tokens), len(labels)) if tokens else np.zeros((0, len(labels)))
                p = np.exp(z - z.max(1, initial=-np.inf)[:, None])
                p /= p.sum(1)[:, None]
                at.append(p.argmax(1).astype(np.int32))
                sure.append(p.max(1, initial=0.0))
                sizes.append(len(tokens))
            label = names.take(pa.array(np.concatenate([np.zeros(0, np.int32), *at])))
            pairs = pa.StructArray.from_arrays([label, pa.array(np.concatenate([np.zeros(0), *sure]))], ["label", "confidence"])
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pairs, mask=windows.is_null())

    return run


def generated(payload: Column, system: str, schema: dict, load: Callable[[], Generate]) -> Column:
    """struct<output, error>: the generator's answer as JSON text for each payload (JSON text), or why there is none.
    A provider that fails costs its row only."""

    @F.pandas_udf("output string, error string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        generate = load()
        for payloads in parts:
            rows = []
            for text in payloads:
                try:
                    rows.append((json.dumps(generate(system, json.loads(text), schema)), None))
                except Exception as e:  # noqa: BLE001  whatever a provider raises
                    rows.append((None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["output", "error"])

    return run(payload)


def first_error(checks: dict[str, Column]) -> Column:
    """The name of the first check that does not hold, null if all do."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()))


def suggestions(rows: DataFrame, text: str = "review_text", output: str = "output") -> DataFrame:
    """Checked suggestions for unknown spans (raw_aspect, start_char, end_char): canonical id and label, or a
    proposed label, an explanation and error. Nothing is applied."""
    get = lambda k: F.get_json_object(output, f"$.{k}")
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    own, label, why = get("canonical_aspect_id"), get("proposed_aspect_label"), get("explanation")
    fields = F.json_object_keys(output)
    error = first_error(
        {
            "span": (F.col("start_char") >= 0) & (F.col("end_char") > F.col("start_char")) & (slice_text(F.col(text), F.col("start_char"), F.col("end_char")) == F.col("raw_aspect")),
            "fields": F.size(F.array_except(fields, F.array(*(F.lit(f) for f in ("canonical_aspect_id", "proposed_aspect_label", "explanation"))))) == 0,
            "explanation": filled(why).isNotNull() & (F.length(why) <= 1000),
            "label": label.isNull() | (F.length(label) <= 120),
            "canonical_id": own.isNull() | own.isin(*ontology.IDS),
        }
    )
    good = lambda c: F.when(F.col("error").isNull(), c)
    return rows.withColumn("error", error).withColumns(
        {
            "canonical_aspect_id": good(own),
            "canonical_aspect_label": good(ontology.label_of(own)),
            "proposed_aspect_label": good(F.when(own.isNull(), filled(label))),
            "explanation": good(filled(why)),
            "applied": F.lit(False),
        }
    )


CLAIMS = "struct<claims:array<struct<text:string,citations:array<struct<review_id:string,quote:string>>>>>"


def answers(rows: DataFrame, contexts: DataFrame, key: str, output: str = "output") -> DataFrame:
    """key, status (answered, insufficient_evidence, invalid) and claims of generated answers.

    contexts: key, review_id, text of what was retrieved (at most eight for a question); a review may come again, with
    the same text or another. Every claim needs text and citations whose quotes stand in their retrieved review; an
    answer with one that does not is invalid.
    """
    found = contexts.groupBy(key).agg(F.collect_set(F.struct("review_id", "text")).alias("found"))
    claims = F.from_json(output, CLAIMS)["claims"]
    both = rows.select(key, claims.alias("claims")).join(found, key, "left")
    quoted = lambda c: F.coalesce((F.trim(c["quote"]) != "") & F.exists("found", lambda f: (f["review_id"] == c["review_id"]) & F.contains(f["text"], c["quote"])), F.lit(False))
    sound = F.forall("claims", lambda c: F.coalesce((F.trim(c["text"]) != "") & F.size(c["citations"]).between(1, 8), F.lit(False)) & F.forall(c["citations"], quoted))
    valid = F.coalesce((F.size("claims") <= 6) & sound, F.lit(False))
    status = F.when(F.col("found").isNull(), "insufficient_evidence").when(~valid, "invalid").when(F.size("claims") > 0, "answered").otherwise("insufficient_evidence")
    return both.withColumn("status", status).select(key, "status", F.when(F.col("status") == "answered", F.col("claims")).alias("claims"))


def explanations(rows: DataFrame, output: str = "output") -> DataFrame:
    """Adds error, summary and trade_off of a comparison's explanation. rows: blocked, supported_features."""
    get = lambda k: F.get_json_object(output, f"$.{k}")
    fits = lambda c, n: F.length(c).between(1, n)
    error = first_error({"evidence": ~F.col("blocked") & (F.col("supported_features") > 0), "summary": fits(get("summary"), 900), "trade_off": fits(get("trade_off"), 600)})
    return rows.withColumn("error", error).withColumns({k: F.when(F.col("error").isNull(), get(k)) for k in ("summary", "trade_off")})


TAKEAWAYS = "struct<features:array<struct<aspect_id:string,takeaway:string>>>"


def takeaways(rows: DataFrame, expected: str = "aspect_ids", output: str = "output") -> DataFrame:
    """Adds error and takeaways: one of 1..450 characters for every aspect, in the comparison's order."""
    got = F.from_json(output, TAKEAWAYS)["features"]
    error = first_error(
        {
            "evidence": F.size(expected) > 0,
            "features": F.transform(got, lambda f: f["aspect_id"]) == F.col(expected),
            "takeaway": F.forall(got, lambda f: F.coalesce(F.length(f["takeaway"]).between(1, 450), F.lit(False))),
        }
    )
    return rows.withColumn("error", error).withColumn("takeaways", F.when(F.col("error").isNull(), got))


class Baseline:
    """TF-IDF of words and word pairs with sublinear counts, rows of length 1, and a logistic regression."""

    def __init__(self, grams: Sequence[str], weighing, labels: Sequence[str]) -> None:
        self.grams, self.weighing, self.labels = list(grams), weighing, list(labels)

    def transform(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """Adds predicted, the label."""
        return self.predicted(gram.damped(rows, self.grams, text)).drop("damped")

    def predicted(self, vectors: DataFrame) -> DataFrame:
        """The same for rows that have their vectors (damped)."""
        out = self.weighing.transform(vectors)
        names = F.array(*(F.lit(x) for x in self.labels))
        return out.select(*vectors.columns, F.get(names, F.col("prediction").cast("int")).alias("predicted"))


def tfidf_baseline(rows: DataFrame, text: str = "text", label: str = "label", most: int = 50_000, iterations: int = 100) -> Baseline:
    """Fitted on rows; classes are balanced by weights. Texts are read twice, for the grams and for the vectors, which are kept."""
    grams = gram.common(rows, text, most)
    return tfidf_regression(cut(gram.damped(rows.select(text, label), grams, text).drop(text)), grams, label, iterations)


def tfidf_regression(vectors: DataFrame, grams: Sequence[str], label: str = "label", iterations: int = 100) -> Baseline:
    """Fitted on rows with vectors (damped), several times read."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, Normalizer, StringIndexer

    counts = vectors.groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("all"), F.count("*").alias("classes"))
    weights = counts.crossJoin(F.broadcast(totals)).select(label, (F.col("all") / (F.col("classes") * F.col("n"))).alias("class_weight"))  # a row per class
    train = vectors.join(F.broadcast(weights), label)
    weighing = [IDF(inputCol="damped", outputCol="weighted"), Normalizer(inputCol="weighted", outputCol="features")]
    index = StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc").fit(train)
    learner = LogisticRegression(featuresCol="features", labelCol="label_index", weightCol="class_weight", maxIter=iterations)
    return Baseline(grams, Pipeline(stages=[*weighing, learner]).fit(index.transform(train)), index.labels)


# Fixed value: how a pointer to a large file begins.
POINTER = b"version https://git-lfs.github.com/spec/"
REQUIRED = ("config.json", "model.safetensors", "tokenizer.json", "tokenizer_config.json")


def checkpoint_files(files: DataFrame, manifest: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    """path, check of a folder's files (path, content) against a manifest (path, sha256): `missing`, `pointer`
    (a large file that was not fetched), `hash`, or `unlisted`. No rows: all is well."""
    have = files.select("path", F.sha2("content", 256).alias("actual"), F.col("content").startswith(F.lit(bytearray(POINTER))).alias("pointer"))
    wanted = files.sparkSession.createDataFrame([(p, True) for p in required], "path string, required boolean").join(manifest, "path", "full")
    rows = wanted.join(have, "path", "full")
    check = (
        F.when(F.col("actual").isNull(), "missing")
        .when(F.col("pointer"), "pointer")
        .when(F.col("sha256").isNull(), "unlisted")
        .when(F.col("sha256") != F.col("actual"), "hash")
    )
    return rows.select("path", check.alias("check")).where("check is not null")


def stub_encoder(dims: int = 8) -> Callable[[], Encode]:
    """A deterministic stand-in for a sentence model: hashed letters triples, length 1."""

    def load() -> Encode:
        def encode(texts: Sequence[str]) -> np.ndarray:
            out = np.zeros((len(texts), dims))
            for i, t in enumerate(texts):
                padded = f"  {t.lower()} "
                for j in range(len(padded) - 2):
                    out[i, hashlib.sha256(padded[j : j + 3].encode()).digest()[0] % dims] += 1
            return out / np.maximum(1e-12, np.linalg.norm(out, axis=1))[:, None]

        return encode

    return load
