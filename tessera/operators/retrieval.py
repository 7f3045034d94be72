"""Question retrieval over reviews, and nearest aspects over embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ontology
from ..functions.text import alias_key, terms
from ..session import cut

# Words of a question that say nothing.
STOP_WORDS = tuple(
    "a an the and or but is are was were be been being of for to in on at by with from about does do did what which how why tell me is it this that product review reviews".split()
)


def question_aspects(question: Column) -> Column:
    """Ids of aspects with an alias in the question, as whole words."""
    padded = F.concat(F.lit(" "), alias_key(question), F.lit(" "))
    hits = F.array(*(F.when(F.greatest(*(F.contains(padded, F.lit(f" {alias} ")) for alias in (*a[2], a[2][0])), F.lit(False)), F.lit(a[0])) for a in ontology.ASPECTS))
    return F.array_compact(hits)


def scored(reviews: DataFrame, question: str = "question", text: str = "text", aspects: str = "aspects") -> DataFrame:
    """Adds score: shared terms, 3 for a shared aspect, shared terms of aspect names; rows above 0 stay.

    aspects: array<string> of aspect names, ids or raw aspects.
    """
    wanted = terms(F.col(question), STOP_WORDS)
    size = lambda c: F.size(F.array_intersect(wanted, F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))))
    ids = F.array_compact(F.transform(aspects, ontology.canonical_id))
    match = F.arrays_overlap(question_aspects(F.col(question)), ids)
    score = size(F.col(text)) + F.when(match, 3).otherwise(0) + size(F.array_join(aspects, " "))
    return reviews.withColumn("score", score).where("score > 0")


def within_budget(rows: DataFrame, key: list[str], item: str, text: str = "text", most: int = 8, characters: int = 18000) -> DataFrame:
    """The best rows of each question, at most `most`, until the characters are used up; the last text is cut.

    A top-k first, so that the running sum sees at most `most` rows of a question.
    """
    order = Window.partitionBy(*key).orderBy(F.desc("score"), item)
    rows = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    used = F.coalesce(F.sum(F.length(text)).over(Window.partitionBy(*key).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("used", used).where(F.col("used") < characters)
    return rows.withColumn(text, F.expr(f"substring({text}, 1, {characters} - used)")).where(F.length(text) > 0).drop("used")


def cited(answers: DataFrame, contexts: DataFrame, key: list[str]) -> DataFrame:
    """Citations (key, review_id, quote) -> valid: the review was retrieved and holds the quote."""
    rows = answers.join(contexts.select(*key, "review_id", "text"), [*key, "review_id"], "left")
    return rows.withColumn("valid", F.coalesce((F.trim("quote") != "") & F.contains("text", "quote"), F.lit(False))).drop("text")


TILE_NUMBERS = 1 << 20  # of vectors in a tile or a block: 8 MB of doubles


def _best_two(key: tuple, queries: pa.Table, prototypes: pa.Table) -> pa.Table:
    """The two best labels of each query of a block among a tile's prototypes: (id, similarity, label)."""
    unit = lambda t: (lambda m: m / np.linalg.norm(m, axis=1, keepdims=True))(t["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, key[2]))
    schema = pa.schema([queries.schema.field("id"), pa.field("similarity", pa.float64()), prototypes.schema.field("label")])
    if not queries.num_rows or not prototypes.num_rows:
        return schema.empty_table()
    prototypes = prototypes.sort_by("label")
    p, q = unit(prototypes), unit(queries)
    code = prototypes["label"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.diff(code, prepend=-1))  # of each label's prototypes
    rows, picks, values = [], [], []
    step = max(1, TILE_NUMBERS // len(p))
    for at in range(0, len(q), step):
        best = np.maximum.reduceat(q[at : at + step] @ p.T, starts, axis=1)
        two = np.argsort(best, axis=1, kind="stable")[:, -2:]  # of equal ones the greater labels
        rows.append(np.repeat(np.arange(at, at + len(best)), two.shape[1]))
        picks.append(starts[two].ravel())
        values.append(np.take_along_axis(best, two, axis=1).ravel())
    rows, picks = np.concatenate(rows), np.concatenate(picks)
    return pa.Table.from_arrays([queries["id"].take(rows), pa.array(np.concatenate(values)), prototypes["label"].take(picks)], schema=schema)


def nearest(queries: DataFrame, prototypes: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """queries: id, vector; prototypes: label, vector, a row per alias, as many as there are. One row per distinct id.

    The best label by cosine; none within the tolerance of a second label or below the threshold. Every query meets every
    prototype of its number of components, in blocks of queries and tiles of prototypes that hold TILE_NUMBERS numbers each: a
    vector is copied once per block of the other side, a task holds one block, one tile and a strip of their product, and gives the best
    two labels, which merge over the tiles. Vectors that are null, zero, or hold null or non-finite components are near nothing: such
    queries are unknown, such prototypes and null labels are left out. Repeated rows count once.
    """
    x = F.col("vector").cast("array<double>")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    usable = F.coalesce(F.forall(x, finite) & F.exists(x, lambda v: v != 0), F.lit(False))
    shape = lambda rows, name: rows.select(name, F.when(usable, x).alias("vector")).dropDuplicates()
    asked, p = cut(shape(queries, "id")), cut(shape(prototypes.where("label is not null"), "label").where("vector is not null"))
    q = asked.where("vector is not null")
    size = lambda rows: rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    (n, wide), (m, wide_p) = size(q), size(p)
    per = max(1, TILE_NUMBERS // max(wide, wide_p))
    blocks, tiles = max(-(-n // per), min(n, q.sparkSession.sparkContext.defaultParallelism), 1), max(-(-m // per), 1)
    part = lambda rows, name, own, count, other, copies: rows.select(
        name, "vector", F.size("vector").alias("dims"), F.pmod(F.xxhash64(name, "vector"), F.lit(count)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias(other)
    )
    keys = ["block", "tile", "dims"]
    left, right = part(q, "id", "block", blocks, "tile", tiles).groupBy(*keys), part(p, "label", "tile", tiles, "block", blocks).groupBy(*keys)
    kinds = [rows.schema[c].dataType.simpleString() for rows, c in ((queries, "id"), (prototypes, "label"))]
    found = left.cogroup(right).applyInArrow(_best_two, f"id {kinds[0]}, similarity double, label {kinds[1]}")
    entries = found.select("id", F.struct("similarity", "label").alias("e"))
    every = entries.unionByName(asked.select("id", F.lit(None).cast(entries.schema["e"].dataType).alias("e")))
    best = every.groupBy("id").agg(F.sort_array(F.collect_list("e"), asc=False).alias("all"))  # two a tile, as nulls are left out
    best = best.withColumn("top", F.get("all", F.lit(0)))
    second = F.get(F.filter("all", lambda e: e["label"] != F.col("top.label")), F.lit(0))["similarity"]
    known = ~F.coalesce(F.col("top.similarity") - second <= tolerance, F.lit(False)) & (F.col("top.similarity") >= threshold)
    return best.select("id", F.when(known, F.col("top.label")).alias("label"), F.round("top.similarity", 6).alias("similarity"), F.when(known, "semantic").otherwise("unknown").alias("method"))


def distinct_encoded(rows: DataFrame, phrase: str, encode) -> DataFrame:
    """Adds `vector`, encoding each distinct phrase once: `encode` maps a Column to a Column, a pandas UDF for a model."""
    vectors = rows.select(phrase).distinct().withColumn("vector", encode(F.col(phrase)))
    return rows.join(vectors, phrase, "left")
