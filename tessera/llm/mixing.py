"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Targets. Source i of weight w_i and size s_i gets min(cap * s_i, L * w_i), with L such that all
targets add up to `share` of all sizes: what capping and resharing the excess by weight, until none
is above, comes to. Sorted by cap * s_i / w_i, a prefix of the sources is capped; two running sums
over the (few) sources give L.

Sampling. A source takes target / size expected copies of each of its documents. Documents stand in
an order by size, so that a stretch of the line holds documents of like size and the words taken come
near the target. Expected copies are prefix-summed along that line, one random offset per source is
added, and a document is emitted once per integer boundary that it crosses.

The line is never sorted in one place: a source is cut into cells (size class, hash of the id), cells
are counted and prefix-summed, and only ranks inside a cell need its rows together. There are as many
hash parts as keep a cell within `cell_rows`, so a source with a third of all rows is many cells.

Defined results: null text has size 0; a null source is a source of its own, last in order; rows that
repeat an id are separate documents, in an order fixed by their text and columns; without any words
all targets are 0 and nothing is taken; an empty table gives an empty table. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut, words_column

WEIGHTS = (3, 1, 2)  # fixed values: the contract's weights, repeating along the ordered sources


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, documents -> with target. One row per source: small however large the corpus."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", cycle).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    line = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    capped = F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(line.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - capped) / open_weight)
    # The first source whose own cap is not below the level that remains sets the level for all after it.
    free = F.col("limit") >= F.col("level") * F.col("weight")
    rows = rows.withColumn("level", F.min(F.when(free, F.struct(F.col("limit") / F.col("weight"), F.col("level").alias("level")))).over(everything)["level"])
    return rows.select("source", "source_size", "documents", F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"))


def size_class(size: str = "size") -> Column:
    """Classes an eighth of a natural logarithm wide, so sizes within one differ by 13 % at most."""
    return F.floor(F.log1p(F.col(size).cast("double")) * 8).cast("int")


def uniform(*parts: Column) -> Column:
    """A reproducible number within (0, 1), away from its ends."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40) * 0.998 + 0.001


def _tie(docs: DataFrame) -> Column:
    """128 bits of all of a row's columns; maps count as they are written."""
    plain = [F.to_json(F.struct(c)) if "map<" in t else F.col(c) for c, t in docs.dtypes]
    return F.struct(F.xxhash64(*plain).alias("a"), F.xxhash64(F.lit(1), *reversed(plain)).alias("b"))


def sample(
    docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 13, cell_rows: int = 20000, doc_id: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken for each row of docs; also `tie`, which
    tells rows of one id apart."""
    # Texts are read once; what follows sees ids, sizes and hashes.
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words_column(text).cast("long").alias("size"), _tie(docs).alias("tie")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    planned = targets(sizes, weights, share, cap)
    largest = sizes.agg(F.coalesce(F.max("documents"), F.lit(0))).first()[0]
    parts = max(16, -(-int(largest) // cell_rows))
    rows = rows.withColumn("class", size_class()).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(parts)).cast("int"))
    cell = ["source", "class", "part"]
    counted = rows.groupBy(*cell).agg(F.count("*").alias("in_cell"))
    # Two levels of running sums: over a source's few size classes, and over the parts of one class.
    ahead = lambda df, column, order, *keys: F.coalesce(F.sum(column).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    classes = counted.groupBy("source", "class").agg(F.sum("in_cell").alias("in_class"))
    classes = classes.select("source", "class", ahead(classes, "in_class", "class", "source").alias("before"))
    inner = counted.select(*cell, ahead(counted, "in_cell", "part", "source", "class").alias("within"))
    on = [inner["source"].eqNullSafe(classes["source"]), inner["class"] == classes["class"]]
    starts = inner.join(classes, on).select(*(inner[c] for c in cell), (classes["before"] + inner["within"]).alias("ahead"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*cell).orderBy("size", "doc_id", "tie")))

    def same(left: DataFrame, right: DataFrame, keys: list[str]):
        return [left[k].eqNullSafe(right[k]) for k in keys]

    ranked = ranked.join(starts, same(ranked, starts, cell), "left").select(*(ranked[c] for c in ("doc_id", "source", "size", "tie", "rank")), starts["ahead"])
    ranked = ranked.join(planned, same(ranked, planned, ["source"]), "left").select(*(ranked[c] for c in ("doc_id", "source", "size", "tie", "rank", "ahead")), *(planned[c] for c in ("source_size", "target")))
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    place = (F.col("ahead") + F.col("rank")).cast("double")
    offset = uniform(F.coalesce("source", F.lit("")), F.col("source").isNull(), F.lit(seed))
    crossed = F.floor(place * rate + offset) - F.floor((place - 1) * rate + offset)
    copies = F.least(F.lit(int(cap)), F.greatest(F.lit(0), crossed)).cast("long")
    out = ranked.withColumn("copies", F.when(F.col("target") > 0, copies).otherwise(F.lit(0)))
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "tie")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of docs themselves, each as often as sampled.

    Rows equal in every column are exchangeable: one of them, found by a partial aggregate, stands for
    all and is emitted as often as they together are.
    """
    copies = sample(docs, doc_id=doc_id, text=text, source=source, **options)
    copies = cut(copies.groupBy("tie").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0"))
    rows = docs.select(_tie(docs).alias("tie"), F.struct("*").alias("row"))
    one = rows.join(copies.where("rows = 1"), "tie").select("row", "copies")
    several = copies.where("rows > 1")
    alike = rows.join(several.select("tie"), "tie", "left_semi").groupBy("tie").agg(F.first("row").alias("row")).join(several, "tie")
    out = one.unionByName(alike.select("row", "copies"))
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select("row.*")
