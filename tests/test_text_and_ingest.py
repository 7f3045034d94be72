import gzip
import hashlib
import html
import json
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from tessera.functions import sentiment, text
from tessera.operators import dedup, history, metrics, retrieval, sampling, spans, validation
from tessera.sources import datasets, imports, jsonl, sinks


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def analyses(spark, review):
    rows = spark.createDataFrame([("r", review)], "review_id string, review_text string")
    return sentiment.analyze(rows).orderBy("start_char").collect()


def test_sentence_with_two_aspects(spark):
    got = analyses(spark, "😀 Amazing display but terrible battery life.")
    assert [(r.raw_aspect, r.normalized_aspect_id, r.sentiment, r.tag) for r in got] == [("display", "display", "positive", "Great Display"), ("battery life", "battery", "negative", "Poor Battery")]
    assert [("😀 Amazing display but terrible battery life."[r.start_char : r.end_char]) for r in got] == ["display", "battery life"]


def test_longest_alias_wins(spark):
    assert [r.raw_aspect for r in analyses(spark, "Poor hard drive capacity")] == ["drive capacity"]
    assert sentiment.longest_first([(0, 4), (2, 9), (9, 11)]) == [(2, 9), (9, 11)]


@pytest.mark.parametrize(("review", "label"), [("not good battery", "negative"), ("The battery isn't good", "positive"), ("never bad battery", "positive"), ("battery", "neutral"), ("barely good battery", "neutral")])
def test_negation(spark, review, label):
    assert analyses(spark, review)[0].sentiment == label


def test_titles_do_not_end_clauses(spark):
    r = analyses(spark, "Slow. Dr. Lee says the battery is great! Bad.")[0]
    assert (r.sentiment, r.context_start_char) == ("positive", 6)


def test_windows_are_merged(spark):
    c = [(0, 7, 0.9, 1, 0), (2, 9, 0.8, 5, 1), (10, 14, 0.5, 2, 0)]
    rows = spark.createDataFrame([("battery life x y", c)], "t string, c array<struct<start_char:int,end_char:int,confidence:double,boundary_margin:int,window_index:int>>")
    got = rows.select(sentiment.merge_windows(F.col("t"), F.col("c"))).first()[0]
    assert [(k.start_char, k.end_char, k.confidence) for k in got] == [(2, 9, 0.8), (10, 14, 0.5)]


def test_bio_rules_differ(spark):
    labels = ["I-ASP", "B-ASP", "I-ASP", "O", "I-ASP", "B-ASP"]
    rows = spark.createDataFrame([(labels,)], "l array<string>")
    run = lambda opens: [tuple(x) for x in rows.select(spans.bio_runs(F.col("l"), opens)).first()[0]]
    assert run(False) == [(1, 3), (5, 6)] and run(True) == [(0, 1), (1, 3), (4, 5), (5, 6)]


def test_keys(spark):
    rows = spark.createDataFrame([("Straße  \tA",), (" strasse a ",)], "t string")
    assert rows.select(text.product_text_key(F.col("t"))).distinct().count() == 1
    assert rows.select(text.product_text_key(F.col("t"), exact=False)).distinct().count() == 2
    assert one(spark, text.token_key(F.col("t")), t="Ａ-b  ﬁ!") == "a b fi"
    assert one(spark, text.clean_review_text(F.col("t")), t="<b>a&amp;b</b> http://x.y z@w.com\x07 ok") == "a&b ok"
    assert one(spark, text.utf16_to_code_points(F.col("t"), F.lit(3), F.lit(4)), t="😀\r\nab") == (3, 4)


def test_spans_count_code_points(spark):
    got = one(spark, text.phrase_spans(F.col("t"), F.lit("Bat.")), t="😀 bat. BAT. bats")
    assert [tuple(x) for x in got] == [(2, 6), (7, 11)]
    assert one(spark, text.unique_phrase_span(F.col("t"), F.lit("a")), t="aa") is None
    assert one(spark, text.indexed_words(F.col("t"), F.lit(1), F.lit(3)), t="a  b  c d") == "b  c"
    assert [tuple(x) for x in one(spark, text.segments(F.col("t"), F.array(F.struct(F.lit(1).alias("start_char"), F.lit(3).alias("end_char")))), t="abcd")] == [("a", False), ("bc", True), ("d", False)]


def test_json_lines_keep_their_places(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"review_text": "Good"}\nbad\n\n{"review_text": null, "text": "x"}\n{"text": " gOOD "}\n', encoding="utf-8")
    rows = validation.import_rows(imports.read_import(spark, str(p))).withColumn("product_id", F.lit("p"))
    got = {r.ordinal: r.outcome for r in dedup.import_outcome(rows).collect()}
    assert got == {1: "accepted", 2: "rejected", 3: "rejected", 4: "rejected", 5: "duplicate"}
    assert dedup.counters(dedup.import_outcome(rows)).first()[1:] == (5, 1, 3, 1)


def test_other_imports(spark, tmp_path):
    (tmp_path / "a.txt").write_text("﻿one\r\n\ntwo\x0bthree", encoding="utf-8")
    assert [(r.ordinal, r.value) for r in imports.read_import(spark, str(tmp_path / "a.txt")).collect()] == [(1, "one"), (2, ""), (3, "two"), (4, "three")]
    (tmp_path / "a.csv").write_text('id,text\n1,"a ""b""\nc"\n', encoding="utf-8")
    assert imports.read_import(spark, str(tmp_path / "a.csv")).first().record["text"] == 'a "b"\nc'
    (tmp_path / "b.csv").write_text("id\n1\n", encoding="utf-8")
    with pytest.raises(Exception, match="CSV needs"):
        imports.read_import(spark, str(tmp_path / "b.csv")).collect()
    (tmp_path / "a.json").write_text('{"reviews": [{"text": "a"}, 3]}', encoding="utf-8")
    assert [r.record for r in imports.read_import(spark, str(tmp_path / "a.json")).collect()] == [{"text": "a"}, None]
    with pytest.raises(ValueError, match="unsupported"):
        imports.read_import(spark, "x.pdf")
    pasted = imports.pasted(spark.createDataFrame([("a\n\nb \r\n \r\n c",)], "content string"))
    assert [r.review_text for r in pasted.collect()] == ["a", "b", "c"]
    page = spark.createDataFrame([("u", "<p>One <b>two</b></p><p hidden>x</p><p>one  TWO</p><script><p>no</p></script><p>3</p>")], "url string, html string")
    assert [r.review_text for r in imports.captured(page).orderBy("ordinal").collect()] == ["One two", "3"]


def test_bounded_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text("".join(json.dumps({"i": i}) + "\n" for i in range(20)) + "bad\n")
    reason = lambda **limit: jsonl.bounded(spark, str(p), **limit)[1].first()[:]
    assert (reason(), reason(max_rows=5), reason(max_bytes=25)) == ((21, "end_of_file"), (5, "row_limit"), (2, "byte_limit"))
    assert jsonl.bounded(spark, str(p))[0].where("malformed").count() == 1
    z = tmp_path / "a.jsonl.gz"
    z.write_bytes(gzip.compress(p.read_bytes()))
    assert jsonl.bounded(spark, str(z))[1].first().stop_reason == "end_of_file"
    assert jsonl.bounded(spark, str(z), max_bytes=30)[1].first().stop_reason == "byte_limit"


def test_batches_resume(spark, tmp_path):
    p, out = tmp_path / "s.jsonl", tmp_path / "out"
    p.write_text("".join(json.dumps({"parent_asin": "ab"[i % 2], "i": i}) + "\n\n" for i in range(10)))

    def run():
        q = jsonl.batches(spark, str(p), 2, ["a"]).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
        q.awaitTermination(60)
        return sorted(r.source_line for r in spark.read.parquet(str(out)).collect())

    assert run() == [1, 5] and run() == [1, 5, 9, 13]


def test_quads(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("the battery is great\t0,2 LAPTOP#B 2 3,4\n\nscreen is bad 0,1 D#Q 0 -1,-1\n")
    got = datasets.indexed_quads(spark, str(tmp_path / "q.tsv"), "train").orderBy("review_id").collect()
    assert [(r.review_id[-5:], r.aspect, r.sentiment, r.opinion) for r in got] == [("00001", "the battery", "positive", "great"), ("00003", "screen", "negative", "")]
    assert tuple(one(spark, datasets.delimited_quad(F.col("t")), t="[screen ||| D ||| neg ||| dim]")) == ("screen", "dim", "negative")


def test_guarded_csv_and_manifest(spark, tmp_path):
    rows = spark.createDataFrame([(1, "=x"), (2, 'a"b')], "i int, t string")
    sinks.write_error_csv(rows, str(tmp_path / "c"))
    assert {r.t for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).collect()} == {"'=x", 'a"b'}
    assert sinks.manifest(rows).collect() == sinks.manifest(rows.orderBy(F.desc("i")).repartition(3)).collect()
    sinks.write_once(rows, str(tmp_path / "w"))
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_once(rows, str(tmp_path / "w"))


def test_sampling(spark):
    rows = spark.createDataFrame([("Laptop 15", ["Computers", "Laptops"]), ("Laptop sleeve", ["Laptops"]), ("Thing", ["Laptops", "Accessories"]), ("", ["Laptops"]), ("Mac", [])], "t string, c array<string>")
    assert [r[0] for r in rows.select(sampling.is_laptop(F.col("t"), F.col("c"))).collect()] == [True, False, False, False, False]
    assert one(spark, sampling.brand(F.col("b"), F.col("d")), b=" ", d='{"Brand": "X"}') == "X"
    ids = spark.range(100).selectExpr("id", "'train' as split")
    moved = sampling.with_validation(ids, "id")
    assert 0 < moved.where("split = 'validation'").count() < 30
    assert sampling.with_validation(moved, "id").exceptAll(moved).count() == 0


def test_histories(spark):
    runs = spark.createDataFrame([("a",), ("b",), ("c",)], "run_id string")
    notes = spark.createDataFrame([("a", 1, 1, "reviewed", 5), ("b", 2, 1, "reviewed", None), ("a", 0, 0, "in_progress", None)], "run_id string, id int, created_at int, status string, correction_revision int")
    fixes = spark.createDataFrame([("a", 4, 1), ("a", 5, 2), ("b", 6, 9)], "run_id string, id int, created_at int")
    got = {r.run_id: (r.status, r.corrections_changed) for r in history.effective_status(runs, notes, fixes).collect()}
    assert got == {"a": ("reviewed", False), "b": ("needs_review", True), "c": ("needs_review", False)}
    items = spark.createDataFrame([("j", 10, "queued"), ("j", 2, "queued")], "job_id string, item_key int, status string")
    assert history.next_items(items).first().item_key == "10"


def test_undefined_ratios(spark):
    none = spark.createDataFrame([], "review_id string, start_char int, end_char int, aspect_id string, sentiment string")
    assert {r["precision"] for r in metrics.joint_scores(none, none).collect()} == {None}
    assert metrics.span_metrics(none, none, ["review_id"]).first()["f1"] == 0.0


def test_annotation_checks(spark):
    rows = [("r", "abc def", 0, 3, "abc", "battery", "positive"), ("r", "abc def", 2, 5, "c d", None, "neutral"), ("s", "abc", 0, 2, "xx", "nope", "glad")]
    got = validation.annotations(spark.createDataFrame(rows, "review_id string, review_text string, start_char int, end_char int, raw_aspect string, canonical_id string, sentiment string"), "review_id").collect()
    assert sorted((r.review_id, r.check) for r in got) == [("r", "overlap"), ("s", "canonical_id"), ("s", "sentiment"), ("s", "span_text")]


def test_all_pages_are_cleaned_as_by_brute_force(spark, tmp_path):
    def brute(v):
        v = html.unescape(v or "")
        for pattern in (r"<[^>]+>", r"https?://\S+|www\.\S+", r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b"):
            v = re.sub(pattern, " ", v)
        return re.sub(r"\s+", " ", "".join(c for c in v if c.isprintable() or c in "\n\t")).strip()

    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    pages += [None, "", "<p>a&nbsp;b &lt;i&gt;c&lt;/i&gt; d&amp;e</p>", "mail é.b+c@d-e.org, a@b", "http://x\u00a0y www.z\u2003ok", "a\x07b\rc\x0bd\u200be\u2028f &#64; x&#64;y.com"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.cleaned for r in driver.queries()["clean_pages"](spark, str(tmp_path)).collect()}
    assert any("@" in p for p in pages[:-6] if p)
    assert got == {i: hashlib.sha256(brute(p).encode()).hexdigest() for i, p in enumerate(pages)}


def test_production_budget_cuts_long_texts(spark):
    rows = spark.createDataFrame([("q", i, 9 - i, chr(97 + i) * 7000) for i in range(4)], "key string, item int, score int, text string")
    got = retrieval.within_budget(rows, ["key"], "item").orderBy("place").collect()
    assert [r.text for r in got] == ["a" * 7000, "b" * 7000, "c" * 4000]
