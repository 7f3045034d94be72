"""Review imports: text, CSV, JSON and JSON lines, with the ordinals of their rows; pasted and captured reviews.

One import is one upload of bounded size, so its rows come from one file; many imports are many files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LINE_ENDS, capture_key

MOST_BYTES = 10 * 1024 * 1024
MOST_ROWS = 5000
TEXT_COLUMNS = ("review_text", "text", "reviewText")


def whole(spark: SparkSession, path: str) -> DataFrame:
    """file, content of each file, byte-order marks stripped; a file above the size limit is an error."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "^\\uFEFF+", "").alias("content"))
    size = F.octet_length("content")
    return raw.withColumn("content", F.when(size <= MOST_BYTES, F.col("content")).otherwise(F.raise_error(F.lit("import exceeds 10 MiB"))))


def limits(files: DataFrame, rows: DataFrame) -> DataFrame:
    """file, bytes, rows and the error of each file: too large, no rows, or too many."""
    n = rows.groupBy("file").agg(F.count("*").alias("rows"))
    out = files.select("file", F.octet_length("content").alias("bytes")).join(n, "file", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    error = F.when(F.col("bytes") > MOST_BYTES, "too_large").when(F.col("rows") == 0, "empty").when(F.col("rows") > MOST_ROWS, "too_many_rows")
    return out.withColumn("error", error)


def checked(rows: DataFrame) -> DataFrame:
    """rows with their file: none, or more than the limit, is an error for the file."""
    n = rows.groupBy("file").agg(F.count("*").alias("rows"))
    ok = F.when(F.col("rows") <= MOST_ROWS, F.col("rows")).otherwise(F.raise_error(F.lit("import exceeds 5000 rows")))
    return rows.join(n.select("file", ok.alias("rows")), "file")


def text_lines(files: DataFrame) -> DataFrame:
    """file, ordinal, value of every line, blank ones included; no line after the last line end."""
    lines = F.split(F.col("content"), LINE_ENDS, -1)
    kept = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    return files.select("file", F.posexplode(kept).alias("at", "value")).select("file", (F.col("at") + 1).alias("ordinal"), "value")


def csv_rows(files: DataFrame) -> DataFrame:
    """file, ordinal, record of a CSV with a header that names a text column; quoted fields may span lines.

    A malformed row, or a header without a text column, is an error.
    """

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv
        import io

        for part in parts:
            for name, content in zip(part["file"], part["content"], strict=True):
                reader = csv.DictReader(io.StringIO(content, newline=""), strict=True)
                if not set(reader.fieldnames or ()) & set(TEXT_COLUMNS):
                    raise ValueError("CSV needs a review_text, text or reviewText column")
                rows = [{k: v for k, v in r.items() if isinstance(k, str)} for r in reader]
                yield pd.DataFrame({"file": name, "ordinal": range(1, len(rows) + 1), "record": rows})

    return files.mapInPandas(parse, "file string, ordinal int, record map<string,string>")


def _record(item) -> object:
    """map of the text columns that are present: a present null stays a null."""
    kind = F.schema_of_variant(item)
    value = {k: F.try_variant_get(item, f"$.{k}", "string") for k in TEXT_COLUMNS}
    present = {k: F.coalesce(F.contains(kind, F.lit(f"{k}:")), F.lit(False)) for k in TEXT_COLUMNS}
    entries = F.array_compact(F.array(*(F.when(present[k], F.struct(F.lit(k).alias("key"), value[k].alias("value"))) for k in TEXT_COLUMNS)))
    return F.when(kind.startswith("OBJECT"), F.map_from_entries(entries))


def json_rows(files: DataFrame) -> DataFrame:
    """file, ordinal, record of a JSON array, or of the `reviews` of an object."""
    top = F.try_parse_json("content")
    items = F.coalesce(F.try_variant_get(top, "$.reviews", "array<variant>"), F.try_variant_get(top, "$", "array<variant>"))
    items = F.coalesce(items, F.raise_error(F.lit("JSON must be an array or an object with reviews")))
    return files.select("file", F.posexplode(items).alias("at", "item")).select("file", (F.col("at") + 1).alias("ordinal"), _record(F.col("item")).alias("record"))


def json_line_rows(files: DataFrame) -> DataFrame:
    """file, ordinal, record of each line; malformed and blank lines stay, with a null record."""
    return text_lines(files).select("file", "ordinal", _record(F.try_parse_json("value")).alias("record"))


def read_import(spark: SparkSession, path: str) -> DataFrame:
    """By the extension: file, ordinal and value (text) or record (the others)."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending not in ("csv", "txt", "json", "jsonl", "ndjson"):
        raise ValueError(f"unsupported import type: .{ending}")
    files = whole(spark, path)
    return {"csv": csv_rows, "txt": text_lines, "json": json_rows}.get(ending, json_line_rows)(files)


def pasted(rows: DataFrame, column: str = "content") -> DataFrame:
    """Reviews of a pasted text, parted by blank lines; 1 to 100 of at most 10000 characters each."""
    parts = F.filter(F.transform(F.split(column, r"\r?\n\s*\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    good = F.size(parts).between(1, 100) & F.forall(parts, lambda x: F.length(x) <= 10000)
    return rows.select("*", F.posexplode(F.when(good, parts).otherwise(F.raise_error(F.lit("paste 1 to 100 reviews of at most 10000 characters")))).alias("at", "review_text")).withColumn("ordinal", F.col("at") + 1).drop("at", column)


def captured(pages: DataFrame, selector: str = "p", most: int = 100, url: str = "url", html: str = "html") -> DataFrame:
    """Texts of a page's elements of one kind, first of each normalised text, at most `most` a page."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from html.parser import HTMLParser

        class Reader(HTMLParser):
            def __init__(self) -> None:
                super().__init__()
                self.depth, self.skipped, self.found = 0, 0, []

            def handle_starttag(self, tag: str, attrs: list) -> None:
                hidden = any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs)
                self.skipped += tag in ("script", "style")
                if tag == selector and not hidden:
                    self.depth += 1
                    self.found.append("")

            def handle_endtag(self, tag: str) -> None:
                self.skipped -= tag in ("script", "style") and self.skipped > 0
                self.depth -= tag == selector and self.depth > 0

            def handle_data(self, data: str) -> None:
                if self.depth and not self.skipped:
                    self.found[-1] += data

        for part in parts:
            rows = []
            for name, body in zip(part["url"], part["html"], strict=True):
                reader = Reader()
                reader.feed(body or "")
                rows += [(name, i, " ".join(t.split())) for i, t in enumerate(reader.found) if t.strip()]
            yield pd.DataFrame(rows, columns=["url", "at", "review_text"])

    rows = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInPandas(run, "url string, at int, review_text string")
    first = rows.groupBy("url", capture_key(F.col("review_text")).alias("key")).agg(F.min_by(F.struct("at", "review_text"), "at").alias("r"))
    per_page = first.groupBy("url").agg(F.slice(F.array_sort(F.collect_list("r")), 1, most).alias("rows"))  # a page's own elements
    return per_page.select("url", F.posexplode("rows").alias("n", "r")).select("url", (F.col("n") + 1).alias("ordinal"), "r.review_text")
