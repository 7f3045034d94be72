"""Annotated review data sets: quads in lines, XML sentences, worksheets; a legacy table; their union."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_review_text, indexed_words, locate_span, sentiment_label

# Fixed value: aspect span, category, sentiment and opinion span of an indexed quad.
QUAD = r"-?\d+,-?\d+\s+\S+\s+[012]\s+-?\d+,-?\d+"


def find_file(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The first path, in order, of a file of that name below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root)
    return files.select("path").orderBy("path").limit(1)


def split_record(line):
    """struct<text, annotations> of a line: by tab, by ####, or before its first indexed quad; null if none."""
    parts = lambda sep: F.filter(F.transform(F.split(line, sep), lambda p: F.trim(p)), lambda p: p != "")
    pick = lambda p: F.struct(p[0].alias("text"), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))).alias("annotations"))
    tab, hashes = parts("\t"), parts("####")
    quads = F.regexp_extract_all(line, F.lit(QUAD), F.lit(0))
    text = F.trim(F.get(F.split(line, QUAD, 2), F.lit(0)))
    return (
        F.when(F.contains(line, F.lit("\t")) & (F.size(tab) >= 2), pick(tab))
        .when(F.contains(line, F.lit("####")) & (F.size(hashes) >= 2), pick(hashes))
        .when((F.size(quads) > 0) & (text != ""), F.struct(text.alias("text"), quads.alias("annotations")))
    )


def indexed_quads(spark: SparkSession, path: str, split: str, source: str = "laptop_acos") -> DataFrame:
    """review_id, review_text, split and the quads of each non-blank line, aspects located in the text."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "line")).where(F.trim("line") != "")
    rows = lines.withColumn("r", split_record(F.col("line"))).withColumn("line_no", F.col("at") + 1)
    rows = rows.select(F.format_string(f"{source}:{split}:%05d", "line_no").alias("review_id"), F.lit(split).alias("split"), F.coalesce("r.text", F.raise_error(F.concat(F.lit("cannot split record: "), F.substring("line", 1, 120)))).alias("review_text"), "r.annotations")
    quads = rows.select("*", F.posexplode("annotations").alias("nth", "quad")).withColumn("f", F.split("quad", r"\s+"))
    bounds = lambda c, i: F.split(c, ",")[i].try_cast("int")
    span = lambda c: indexed_words(F.col("review_text"), bounds(c, 0), bounds(c, 1))
    four = quads.where(F.size("f") == 4)
    return four.select(
        "review_id", "split", "review_text", "nth",
        span(F.col("f")[0]).alias("aspect"), F.col("f")[1].alias("category"), sentiment_label(F.col("f")[2]).alias("sentiment"), F.coalesce(span(F.col("f")[3]), F.lit("")).alias("opinion"),
    ).where("aspect is not null and sentiment is not null")


def delimited_quad(token):
    """struct<aspect, opinion, sentiment> of a four-part annotation; the sentiment is third or last."""
    raw = F.regexp_replace(F.trim(token), r"^[\[\](){}]+|[\[\](){}]+$", "")
    split = lambda sep: F.filter(F.transform(F.split(raw, sep), lambda p: F.trim(p)), lambda p: p != "")
    options = [(F.contains(raw, F.lit(s)), split(re.escape(s) if s != "\t" else s)) for s in ("####", "|||", "###", "\t", "|", ";")]
    parts = F.coalesce(*(F.when(has & (F.size(p) == 4), p) for has, p in options), F.when(F.size(split(r"\s+")) == 4, split(r"\s+")))
    labels = F.transform(parts, lambda p: sentiment_label(p))
    at = F.array_position(F.transform(labels, lambda v: v.isNotNull()), True)
    aspect = F.get(parts, F.lit(0))
    opinion = F.when(at == 3, F.get(parts, F.lit(3))).when(at == 4, F.get(parts, F.lit(2)))
    good = opinion.isNotNull() & (aspect != "") & ~F.lower(aspect).isin("null", "none", "nan")
    return F.when(good, F.struct(aspect.alias("aspect"), opinion.alias("opinion"), F.get(labels, (at - 1).cast("int")).alias("sentiment")))


def xml_sentences(spark: SparkSession, path: str, split: str, source: str = "semeval") -> DataFrame:
    """review_id, text and aspect terms of `sentence` elements; offsets from the file where they fit the
    text, else the first occurrence."""
    kind = "_id string, text string, aspectTerms struct<aspectTerm: array<struct<_term: string, _polarity: string, _from: int, _to: int>>>"
    rows = spark.read.format("xml").option("rowTag", "sentence").schema(kind).load(path)
    rows = rows.select(F.format_string(f"{source}:{split}:%s", "_id").alias("review_id"), F.lit(split).alias("split"), F.col("text").alias("review_text"), F.posexplode_outer("aspectTerms.aspectTerm").alias("nth", "t"))
    stated = F.struct(F.col("t._from").alias("start_char"), F.col("t._to").alias("end_char"))
    fits = F.substring(F.col("review_text"), F.col("t._from") + 1, F.col("t._to") - F.col("t._from")) == F.col("t._term")
    found = locate_span(F.col("review_text"), F.col("t._term"), F.array().cast("array<struct<start_char:int,end_char:int>>"))
    return rows.select("review_id", "split", "review_text", "nth", F.col("t._term").alias("aspect"), sentiment_label(F.col("t._polarity")).alias("sentiment"), F.when(F.coalesce(fits, F.lit(False)), stated).otherwise(found).alias("span"))


def _cells(content: bytes) -> Iterator[tuple[int, dict[str, str | None]]]:
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{space}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{space}si")]
        sheet = min(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{space}row"):
            out: dict[str, str | None] = {}
            for c in row.iter(f"{space}c"):
                if c.find(f"{space}f") is not None:
                    raise ValueError("formulas are not accepted")
                value = c.find(f"{space}v")
                raw = value.text if value is not None else None
                if c.get("t") == "s" and raw is not None:
                    raw = shared[int(raw)]
                elif c.get("t") == "inlineStr":
                    raw = "".join(t.text or "" for t in c.iter(f"{space}t"))
                out[re.sub(r"\d", "", c.get("r", ""))] = raw
            yield int(row.get("r", "0")), out


def worksheet(spark: SparkSession, path: str, fill: tuple[str, ...] = ("A", "B", "C"), columns: str = "ABCDEF") -> DataFrame:
    """file, source_row and columns by letter of the first sheet; merged columns filled down the rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                rows = [(name, r, *(cells.get(c) or None for c in columns)) for r, cells in _cells(content)]
                yield pd.DataFrame(rows, columns=["file", "source_row", *columns])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(run, "file string, source_row int, " + ", ".join(f"{c} string" for c in columns))
    down = Window.partitionBy("file").orderBy("source_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(down) for c in fill})


def legacy_reviews(table: DataFrame, product_id: str, payload: str = "payload") -> DataFrame:
    """Reviews of one product from JSON payloads; a blank text is an error."""
    text = F.get_json_object(payload, "$.review.review_text")
    good = F.when(F.trim(text) != "", text).otherwise(F.raise_error(F.lit("legacy review without text")))
    return table.where(F.col("product_id") == product_id).select(good.alias("review_text"))


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A relational source; filters and columns of `query` run there."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def split_file(spark: SparkSession, folder: str, split: str) -> DataFrame:
    span = "start_char int, end_char int, aspect string, normalized_aspect string, opinion string, sentiment string"
    fields = ", ".join(f.replace(" ", ": ", 1) for f in span.split(", "))
    return spark.read.schema(f"review_id string, review_text string, annotations array<struct<{fields}>>").json(f"{folder}/{split}.jsonl")


def union(*sources: DataFrame) -> DataFrame:
    """A bag union by name; columns that a source lacks are null."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def human_labels(rows: DataFrame, order: str, expected: int = 200) -> DataFrame:
    """The first half is for development, the rest held out; another number of rows is an error."""
    n = rows.agg(F.count("*").alias("_n"))
    rows = rows.crossJoin(F.broadcast(n)).withColumn("_at", F.row_number().over(Window.orderBy(order)))  # one row; the file is `expected` rows
    split = F.when(F.col("_n") != expected, F.raise_error(F.lit(f"expected {expected} labelled rows"))).when(F.col("_at") <= expected // 2, "development").otherwise("heldout")
    return rows.withColumn("split", split).drop("_n", "_at")


def cleaned(rows: DataFrame, text: str = "review_text") -> DataFrame:
    return rows.withColumn(text, clean_review_text(F.col(text)))


def synthetic_examples(spark: SparkSession, wrappers: dict[str, str], unknown: dict[str, list[str]]) -> DataFrame:
    """Every alias in every wrapper of a split, and the split's unknown terms: text, gold, split."""
    from ..functions import ontology

    w = spark.createDataFrame(list(wrappers.items()), "split string, wrapper string")
    known = ontology.aliases(spark).crossJoin(F.broadcast(w))  # both of fixed size
    known = known.select("split", F.expr("replace(wrapper, '{}', alias)").alias("text"), F.col("aspect_id").alias("gold"))
    more = spark.createDataFrame([(s, t, None) for s, terms in unknown.items() for t in terms], "split string, text string, gold string")
    return known.unionByName(more)
