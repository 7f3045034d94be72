"""Evaluation metrics as grouped counts. Where a denominator is 0 the result is 0, or null where said."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import selected


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    value = F.try_divide(a.cast("double"), b.cast("double"))
    return value if empty is None else F.coalesce(value, F.lit(empty))


def f1(p: Column, r: Column, empty: float | None = 0.0) -> Column:
    return ratio(2 * p * r, p + r, empty)


def confusion(rows: DataFrame, labels: list[str], gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """A row per gold label, a column per predicted one, zeros included."""
    counts = rows.groupBy(gold).pivot(predicted, labels).count().na.fill(0)
    every = rows.sparkSession.createDataFrame([(x,) for x in labels], f"{gold} string")
    return every.join(counts, gold, "left").na.fill(0)


def class_metrics(rows: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support per label. Each row is counted twice at most; nothing is joined."""
    sides = F.explode(F.array(F.struct(F.col(gold).alias("label"), F.lit(1).alias("is_gold"), F.lit(0).alias("is_pred")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("is_gold"), F.lit(1).alias("is_pred"))))
    hit = (F.col(gold) == F.col(predicted)).cast("int").alias("hit")
    out = rows.select(hit, sides.alias("s")).groupBy("s.label").agg(F.sum("s.is_gold").alias("support"), F.sum("s.is_pred").alias("predicted"), F.sum(F.col("hit") * F.col("s.is_gold")).alias("tp"))
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return out.select("label", "support", F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(f1(p, r), 9).alias("f1"))


def overall(rows: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """Accuracy and macro averages."""
    per = class_metrics(rows, gold, predicted)
    macro = per.agg(*(F.round(F.avg(c), 9).alias(f"macro_{c}") for c in ("precision", "recall", "f1")))
    return rows.agg(F.round(ratio(F.count_if(F.col(gold) == F.col(predicted)), F.count("*")), 9).alias("accuracy"), F.count("*").alias("support")).crossJoin(F.broadcast(macro))  # one row each


def span_metrics(gold: DataFrame, predicted: DataFrame, keys: list[str], empty: float | None = 0.0) -> DataFrame:
    """tp, fp, fn, precision, recall, F1 of exact matches on keys."""
    g, p = gold.select(*keys).distinct().withColumn("g", F.lit(1)), predicted.select(*keys).distinct().withColumn("p", F.lit(1))
    n = g.join(p, keys, "full").agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp"), empty), ratio(F.col("tp"), F.col("tp") + F.col("fn"), empty)
    return n.select("tp", "fp", "fn", F.round(precision, 9).alias("precision"), F.round(recall, 9).alias("recall"), F.round(f1(precision, recall, empty), 9).alias("f1"))


def joint_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Spans alone, and spans with aspect and sentiment; undefined ratios are null."""
    keys = ["review_id", "start_char", "end_char"]
    parts = [span_metrics(gold, predicted, k, None).withColumn("level", F.lit(n)) for n, k in (("span", keys), ("joint", [*keys, "aspect_id", "sentiment"]))]
    return parts[0].unionByName(parts[1])


def error_categories(rows: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    wrong = rows.where(F.col(gold) != F.col(predicted))
    return wrong.groupBy(F.concat_ws("_to_", gold, predicted).alias("category")).count().withColumnRenamed("count", "errors")


def error_rows(gold: DataFrame, predicted: DataFrame, key: str, item: str) -> DataFrame:
    """Per key the items missing and extra, with the kinds of error; keys without errors are left out."""
    g = gold.groupBy(key).agg(F.collect_set(item).alias("g"))
    p = predicted.groupBy(key).agg(F.collect_set(item).alias("p"))
    none = F.array().cast(g.schema["g"].dataType)
    rows = g.join(p, key, "full").select(key, F.coalesce("g", none).alias("g"), F.coalesce("p", none).alias("p"))
    rows = rows.select(key, F.array_sort(F.array_except("g", "p")).alias("missing"), F.array_sort(F.array_except("p", "g")).alias("extra"))
    m, e = F.size("missing") > 0, F.size("extra") > 0
    kinds = F.array_compact(F.array(F.when(m, "missing_span"), F.when(e, "extra_span"), F.when(m & e, "span_or_text_mismatch")))
    return rows.withColumn("error_types", kinds).where(m | e)


def normalization_metrics(rows: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """Accuracy with unknowns counted, and predictions of a known aspect for an unknown one."""
    g, p = F.coalesce(gold, F.lit("unknown")), F.coalesce(predicted, F.lit("unknown"))
    return rows.agg(F.round(ratio(F.count_if(g == p), F.count("*")), 9).alias("accuracy"), F.count_if((g == "unknown") & (p != "unknown")).alias("false_known"), F.count("*").alias("examples"))


def threshold_sweep(scored: DataFrame, low: int = 50, high: int = 90, step: int = 2) -> DataFrame:
    """scored: gold, candidate, similarity. A candidate counts from its threshold on. Every threshold is a
    row of a sequence that each example is counted in, so the examples are read once."""
    grid = F.explode(F.sequence(F.lit(low), F.lit(high), F.lit(step))).alias("percent")
    rows = scored.select("gold", "candidate", "similarity", grid)
    p = F.when(F.col("similarity") >= F.col("percent") / F.lit(100.0), F.col("candidate"))
    rows = rows.withColumn("predicted", p)
    g, q = F.coalesce("gold", F.lit("unknown")), F.coalesce("predicted", F.lit("unknown"))
    return rows.groupBy("percent").agg(F.round(ratio(F.count_if(g == q), F.count("*")), 9).alias("accuracy"), F.count_if((g == "unknown") & (q != "unknown")).alias("false_known"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    return sweep.agg(F.max(F.struct("accuracy", (-F.col("false_known")).alias("_least"), "percent")).alias("b")).select("b.percent", "b.accuracy", (-F.col("b._least")).alias("false_known"))


def choose_policy(per_class: DataFrame) -> DataFrame:
    """per_class: policy, label, recall, f1. Policies with every recall at least 0.5 are eligible; within
    0.001 of macro F1 the full review wins, else the higher."""
    p = per_class.groupBy("policy").agg(F.min("recall").alias("least"), F.avg("f1").alias("macro_f1")).withColumn("macro_f1", F.when(F.col("least") >= F.lit(0.5), F.col("macro_f1")))
    both = p.agg(F.max(F.when(F.col("policy") == "full_review", F.col("macro_f1"))).alias("full"), F.max(F.when(F.col("policy") == "local_clause", F.col("macro_f1"))).alias("local"))
    full, local = F.col("full"), F.col("local")
    pick = F.when(full.isNull() & local.isNull(), F.lit(None)).when(local.isNull() | (full.isNotNull() & ((full >= local) | (F.abs(full - local) <= F.lit(0.001)))), "full_review").otherwise("local_clause")
    return both.select(pick.cast("string").alias("policy"), "full", "local")


def latency_summary(rows: DataFrame, value: str = "value", *keys: str) -> DataFrame:
    """Least, median, mean, nearest-rank 95th percentile and most: exact, and without the values of a key in one task.

    A key whose values are all null has 0 samples and nulls. Ranks are those of the values as doubles.
    """
    v, n = F.col(value), F.col("n")
    plain = rows.groupBy(*keys).agg(F.min(v).alias("least"), F.round(F.avg(v), 6).alias("mean"), F.max(v).alias("most"), F.count(v).alias("samples"))
    wanted = {"low": F.floor((n + 1) / 2), "high": F.floor(n / 2) + 1, "p95": F.floor((n * 95 + 99) / 100)}
    own = [F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]
    pick = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    found = selected(rows, value, keys, wanted).groupBy(*own).agg(F.round((pick("low") + pick("high")) / 2, 6).alias("median"), pick("p95").cast(rows.schema[value].dataType).alias("p95"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)), F.lit(True))
    return plain.join(found, same, "left").select(*keys, "least", "median", "mean", "p95", "most", "samples")


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """total / rows of the label."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    return counts.select(label, "n", F.round(F.sum("n").over(Window.partitionBy()) / F.col("n"), 9).alias("weight"))


def dataset_statistics(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by each column alone, as grouping sets over one scan: (column, value, rows)."""
    names = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("s")
    return rows.select(names).groupBy("s.column", "s.value").count().withColumnRenamed("count", "rows")


def normalization_recall(rows: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """label (`unknown` for null), correct, total and recall per gold label."""
    g, p = F.coalesce(gold, F.lit("unknown")), F.coalesce(predicted, F.lit("unknown"))
    per = rows.groupBy(g.alias("label")).agg(F.count_if(g == p).alias("correct"), F.count("*").alias("total"))
    return per.withColumn("recall", F.round(ratio(F.col("correct"), F.col("total")), 9))


# What a held-out evaluation must reach, and the older baselines that it must beat.
GATES = {"span_f1": 0.70, "macro_f1": 0.65, "recall": 0.5, "rule_baseline": 0.36719286204529855, "tfidf_baseline": 0.6173789003975411}


def gates(span_f1: DataFrame, per_class: DataFrame) -> DataFrame:
    """gate, passed. span_f1: one row with f1; per_class: label, recall, f1."""
    macro = per_class.agg(F.avg("f1").alias("macro_f1"), F.min("recall").alias("least"))
    one = span_f1.select(F.col("f1").alias("span_f1")).crossJoin(F.broadcast(macro))  # one row each
    span, f, least = F.col("span_f1"), F.col("macro_f1"), F.col("least")
    checks = {
        "span_f1": span >= GATES["span_f1"],
        "span_f1_above_rules": span > GATES["rule_baseline"],
        "macro_f1": f >= GATES["macro_f1"],
        "every_recall": least >= GATES["recall"],
        "macro_f1_above_tfidf": f > GATES["tfidf_baseline"],
    }
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("gate"), F.coalesce(c, F.lit(False)).alias("passed")) for k, c in checks.items()))).alias("g")).select("g.*")


def token_metrics(rows: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """Accuracy and macro averages over tokens. rows: two arrays of labels; tokens beyond the shorter one are
    left out, as are those without a gold label."""
    pairs = rows.select(F.explode(F.arrays_zip(F.col(gold).alias("g"), F.col(predicted).alias("p"))).alias("t")).select(F.col("t.g").alias("gold"), F.col("t.p").alias("predicted"))
    return overall(pairs.where("gold is not null and predicted is not null"))
