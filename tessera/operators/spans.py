"""Token windows and BIO labels, within arrays: a document's tokens are few and stay in its row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_windows(tokens: Column, capacity: int = 254, overlap: int = 64) -> Column:
    """array<struct<window_index, start, tokens>>: windows of `capacity`, the last one reaching the end."""
    step = capacity - overlap
    n = F.size(tokens)
    count = F.when(n <= capacity, 1).otherwise(F.ceil((n - capacity) / F.lit(step)).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("window_index"), (i * step).alias("start"), F.slice(tokens, i * step + 1, F.lit(capacity)).alias("tokens")))


def bio_runs(labels: Column, orphan_opens: bool) -> Column:
    """array<struct<start, end>> of B-ASP followed by I-ASP; an I without a B opens a run or is dropped."""
    kind = "array<struct<start:int,end:int>>"
    start = F.struct(F.lit(None).cast("int").alias("open"), F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    closed = lambda acc: F.when(acc["open"].isNotNull(), F.concat(acc["out"], F.array(F.struct(acc["open"].alias("start"), acc["at"].alias("end"))))).otherwise(acc["out"])

    def step(acc: Column, label: Column) -> Column:
        opens = (label == "B-ASP") | (F.lit(orphan_opens) & (label == "I-ASP") & acc["open"].isNull())
        stays = (label == "I-ASP") & acc["open"].isNotNull()
        at = acc["at"] + 1
        return (
            F.when(opens, F.struct(acc["at"].alias("open"), at.alias("at"), closed(acc).alias("out")))
            .when(stays, F.struct(acc["open"].alias("open"), at.alias("at"), acc["out"].alias("out")))
            .otherwise(F.struct(F.lit(None).cast("int").alias("open"), at.alias("at"), closed(acc).alias("out")))
        )

    return F.aggregate(labels, start, step, closed)


def window_spans(labels: Column, confidences: Column, offsets: Column, window_index: Column) -> Column:
    """Candidates of one window: character span, mean confidence and distance from the window's edges."""
    last = F.size(labels) - 1
    mean = lambda r: F.aggregate(F.slice(confidences, r["start"] + 1, r["end"] - r["start"]), F.lit(0.0), lambda a, v: a + v) / (r["end"] - r["start"])
    return F.transform(
        bio_runs(labels, orphan_opens=False),
        lambda r: F.struct(
            F.get(offsets, r["start"])["start_char"].alias("start_char"),
            F.get(offsets, r["end"] - 1)["end_char"].alias("end_char"),
            mean(r).alias("confidence"),
            F.least(r["start"], last - (r["end"] - 1)).alias("boundary_margin"),
            window_index.alias("window_index"),
        ),
    )


def centred_context(tokens: Column, start: Column, end: Column, budget: int) -> Column:
    """`budget` tokens around tokens start..end-1, moved inwards at the ends of the text."""
    n = F.size(tokens)
    spare = F.greatest(F.lit(budget) - (end - start), F.lit(0))
    low = F.greatest(F.lit(0), F.least(start - F.floor(spare / 2).cast("int"), n - budget))
    return F.when(n <= budget, tokens).otherwise(F.slice(tokens, low + 1, F.lit(budget)))


def align_bio(offsets: Column, spans: Column) -> Column:
    """BIO label of each token from character spans: B for a span's first token, I for its others."""

    def one(t: Column) -> Column:
        inside = F.filter(spans, lambda s: (t["start_char"] < s["end_char"]) & (t["end_char"] > s["start_char"]))
        first = F.exists(inside, lambda s: ~F.exists(offsets, lambda o: (o["start_char"] < t["start_char"]) & (o["start_char"] < s["end_char"]) & (o["end_char"] > s["start_char"])))
        return F.when(F.size(inside) == 0, "O").when(first, "B-ASP").otherwise("I-ASP")

    return F.transform(offsets, one)


def overlapping(spans: Column) -> Column:
    """Whether any two spans of an array overlap."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start_char"].alias("a"), s["end_char"].alias("b"))))
    start = F.struct(F.lit(-1).alias("end"), F.lit(False).alias("clash"))
    return F.aggregate(order, start, lambda acc, s: F.struct(F.greatest(acc["end"], s["b"]).alias("end"), (acc["clash"] | (s["a"] < acc["end"])).alias("clash")), lambda acc: acc["clash"])
