"""Text keys, cleaning and offsets. Offsets are code points, end-exclusive."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Line ends that a text file is split at.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def alias_key(x: Column) -> Column:
    """Lower case, runs of other than a-z and 0-9 become one blank."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def collapsed(x: Column) -> Column:
    """White space of any kind collapsed to single blanks, none at the ends."""
    return F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), "^ | $", "")


@F.pandas_udf(T.StringType())
def casefold(x: pd.Series) -> pd.Series:
    """Full Unicode case folding, which `lower` is not for letters such as sharp s."""
    return x.map(lambda v: None if v is None else v.casefold())


@F.pandas_udf(T.StringType())
def token_key(x: pd.Series) -> pd.Series:
    """NFKC and case folded word tokens joined by a blank; the stripped text if there are none."""

    def one(v: str | None) -> str | None:
        if v is None:
            return None
        tokens = re.findall(r"\w+", unicodedata.normalize("NFKC", v).casefold())
        return " ".join(tokens) or v.strip()

    return x.map(one)


def product_text_key(x: Column, exact: bool = True) -> Column:
    """sha256 of the collapsed, folded text; `exact=False` folds with `lower`, inside the JVM."""
    folded = casefold(collapsed(x)) if exact else F.lower(collapsed(x))
    return F.sha2(folded, 256)


def capture_key(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"(?U)\s+", " "))


def without_markup(x: Column) -> Column:
    """Tags, URLs and e-mail addresses become blanks, unprintable characters go, white space collapses."""
    for pattern in (r"<[^>]+>", r"https?://\S+|www\.\S+", r"(?U)\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b"):
        x = F.regexp_replace(x, pattern, " ")
    return collapsed(F.regexp_replace(x, r"[\p{Cc}\p{Cf}\p{Co}\p{Cn}&&[^\s]]", ""))


_MARKUP = [re.compile(p) for p in (r"<[^>]+>", r"https?://\S+|www\.\S+", r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b")]


@F.pandas_udf(T.StringType())
def clean_review_text(x: pd.Series) -> pd.Series:
    """HTML entities resolved, then as `without_markup`, on Python's classes: a no-break space is unprintable."""

    def one(v: str | None) -> str | None:
        if v is None:
            return None
        v = html.unescape(v)
        for pattern in _MARKUP:
            v = pattern.sub(" ", v)
        return " ".join("".join(c for c in v if c.isprintable() or c in "\n\t").split())

    return x.map(one)


def formula_guard(x: Column, also_controls: bool = False) -> Column:
    """A quote before what a spreadsheet would run as a formula."""
    pattern = r"^[=+\-@\t\r]" if also_controls else r"^[=+\-@]"
    return F.when(x.rlike(pattern), F.concat(F.lit("'"), x)).otherwise(x)


def sentiment_label(x: Column) -> Column:
    """Spellings of the three labels; null for others."""
    key = F.lower(F.trim(x.cast("string")))
    return (
        F.when(key.isin("0", "neg", "negative"), "negative")
        .when(key.isin("1", "neu", "neutral"), "neutral")
        .when(key.isin("2", "pos", "positive"), "positive")
    )


def split_of(review_id: Column) -> Column:
    return F.when(review_id.contains(":train:"), "train").when(review_id.contains(":dev:") | review_id.contains(":validation:"), "validation").when(review_id.contains(":test:"), "test").otherwise("train")


def aspect_review_pair(aspect: Column, review: Column) -> Column:
    return F.concat(F.lit("aspect: "), aspect, F.lit(" [SEP] review: "), review)


def quoted(pattern: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", pattern)


def matches(x: Column, pattern: Column | str) -> Column:
    """array<struct<start_char, end_char>> of all matches of a regex, in code points.

    Built from the lengths of gaps and matches: engine offsets count UTF-16 units.
    """
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    gaps = F.transform(F.split(x, p, -1), lambda g: F.length(g))
    sizes = F.transform(F.regexp_extract_all(x, p, F.lit(0)), lambda m: F.length(m))
    zipped = F.arrays_zip(gaps.alias("gap"), sizes.alias("size"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start_char:int,end_char:int>>").alias("found"))

    def step(acc: Column, z: Column) -> Column:
        at = acc["at"] + z["gap"]
        end = at + z["size"]
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(F.struct(at.alias("start_char"), end.alias("end_char")))).alias("found"))

    return F.aggregate(F.filter(zipped, lambda z: z["size"].isNotNull()), start, step, lambda acc: acc["found"])


def phrase_spans(x: Column, phrase: Column) -> Column:
    """Occurrences of a phrase whatever its case."""
    escaped = F.regexp_replace(phrase, r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    return matches(x, F.concat(F.lit("(?iU)"), escaped))


def unique_phrase_span(x: Column, phrase: Column) -> Column:
    """The span of a phrase that occurs exactly once, else null."""
    found = phrase_spans(x, phrase)
    return F.when(F.size(found) == 1, found[0])


def nth_phrase_span(x: Column, phrase: Column, n: Column) -> Column:
    """The n-th occurrence, counted from 1, else null."""
    return F.try_element_at(phrase_spans(x, phrase), n.cast("int"))


def locate_span(x: Column, phrase: Column, occupied: Column) -> Column:
    """The first occurrence that is not among the occupied spans."""
    return F.try_element_at(F.array_except(phrase_spans(x, phrase), occupied), F.lit(1))


def slice_text(x: Column, start: Column, end: Column) -> Column:
    return F.substring(x, start + 1, end - start)


def indexed_words(x: Column, start: Column, end: Column) -> Column:
    """The text from word `start` to word `end` - 1; null where the range is empty or outside."""
    words = matches(x, r"(?U)\S+")
    inside = (start >= 0) & (end > start) & (end <= F.size(words))
    return F.when(inside, slice_text(x, F.get(words, start)["start_char"], F.get(words, end - 1)["end_char"]))


def segments(x: Column, spans: Column) -> Column:
    """array<struct<text, highlighted>>: the text cut at spans in order, overlapping ones skipped."""
    kind = "array<struct<text:string,highlighted:boolean>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    piece = lambda t, h: F.array(F.struct(t.alias("text"), F.lit(h).alias("highlighted")))

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start_char"] > acc["at"], piece(slice_text(x, acc["at"], s["start_char"]), False)).otherwise(F.array().cast(kind))
        taken = F.struct(s["end_char"].alias("at"), F.concat(acc["out"], gap, piece(slice_text(x, s["start_char"], s["end_char"]), True)).alias("out"))
        return F.when((s["start_char"] >= acc["at"]) & (s["end_char"] > s["start_char"]) & (s["end_char"] <= F.length(x)), taken).otherwise(acc)

    rest = lambda acc: F.concat(acc["out"], F.when(acc["at"] < F.length(x), piece(slice_text(x, acc["at"], F.length(x)), False)).otherwise(F.array().cast(kind)))
    return F.aggregate(F.array_sort(spans), start, step, rest)


@F.pandas_udf(T.StructType([T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType())]))
def utf16_to_code_points(x: pd.Series, start: pd.Series, end: pd.Series) -> pd.DataFrame:
    """Offsets counted in UTF-16 units, as browsers do, with CRLF as one, to code points of the text."""
    rows = []
    for text, a, b in zip(x, start, end, strict=True):
        if text is None or pd.isna(a) or pd.isna(b):
            rows.append((None, None))
            continue
        at, places = 0, {}
        i = 0
        while i <= len(text):
            places.setdefault(at, i)
            if i == len(text):
                break
            if text[i] == "\r" and text[i + 1 : i + 2] == "\n":
                i += 1
            at += 2 if ord(text[i]) > 0xFFFF else 1
            i += 1
        rows.append((places.get(int(a)), places.get(int(b))))
    return pd.DataFrame(rows, columns=["start_char", "end_char"]).astype("Int32")


def terms(x: Column, stop_words: tuple[str, ...]) -> Column:
    """Distinct lower-case terms without stop words."""
    return F.array_except(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0)), F.array(*(F.lit(w) for w in stop_words)))
