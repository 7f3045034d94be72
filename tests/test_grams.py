"""Words, pairs and vectors against Spark's own stages, and how often the baseline reads its texts."""

import unicodedata
import zlib

import numpy as np
from pyspark.ml.feature import CountVectorizerModel, NGram, RegexTokenizer
from pyspark.sql import functions as F

import __spark_entry__ as driver
from tessera import session
from tessera.functions import grams, models
from tessera.plans import models as plans

ODD = (
    "Straße ΣΑΣ İstanbul don't a bc_d __ x1 12 ½½ a½b ²³ été ́́ ́a क्षि a‍b ‌‍ Ⓐⓑ ⅣⅤ a‿b ⁀⁀ 漢字 x😀y 𝒜𝒷 🅐🅑 𝟘𝟙 a­b ab cd 9.5 ٣٤ ①② ㊀㊁ ꙰a",
    "",
    "a b c",
    "one two one two one",
    "Two\tone\n\none, two! three",
)


def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "id int, text string")


def spark_words(rows):
    return RegexTokenizer(inputCol="text", outputCol="words", pattern=r"(?U)\b\w\w+\b", gaps=False).transform(rows)


def test_words_are_those_of_the_tokenizer(spark):
    for r in spark_words(texts(spark)).collect():
        assert grams.words(r.text) == r.words
    old = [chr(p) for p in range(0x20000) if not 0xD800 <= p < 0xE000 and unicodedata.ucd_3_2_0.category(chr(p)) != "Cn"]  # Java and Python know these alike
    rows = spark.createDataFrame([(c * 2,) for c in old], "text string")
    assert [r.text for r in spark_words(rows).collect() if grams.words(r.text) != r.words] == []


def test_vectors_are_those_of_the_count_vectorizer(spark, monkeypatch):
    monkeypatch.setattr(grams, "WORDS_AT_ONCE", 3)
    monkeypatch.setattr(grams, "ROWS_AT_ONCE", 2)
    rows = texts(spark)
    known = grams.common(rows, most=1000)
    both = NGram(n=2, inputCol="words", outputCol="pairs").transform(spark_words(rows)).withColumn("grams", F.concat("words", "pairs"))
    want = {r.gram: r.n for r in both.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).collect()}
    assert {r.gram: r.n for r in grams.counts(rows).collect()} == want
    assert known == sorted(want, key=lambda g: (-want[g], g))  # ASCII or not, code points decide
    for some in (known, known[:2], ["two one", "nowhere", "three"]):
        counted = CountVectorizerModel.from_vocabulary(some, inputCol="grams", outputCol="counts").transform(both)
        for r in grams.damped(counted, some).collect():
            assert list(r.damped.indices) == list(r.counts.indices) and r.damped.size == len(some)
            assert np.array_equal(r.damped.values, 1 + np.log(r.counts.values))


def test_the_baseline_reads_its_texts_twice(spark):
    read = spark.sparkContext.accumulator(0)

    def counting(text):
        read.add(1)
        return text

    frame = spark.createDataFrame([(f"{'good fine' if i % 3 else 'bad poor'} w{i}", "a" if i % 3 else "b") for i in range(60)], "text string, label string")
    rows = frame.withColumn("text", F.udf(counting, "string").asNondeterministic()("text"))
    fitted = models.tfidf_baseline(rows, most=500, iterations=5)
    assert read.value == 120
    assert fitted.transform(frame).where("predicted = label").count() == 60


def test_a_tasks_texts_do_not_grow_with_the_table(spark, monkeypatch):
    """A document counts as eight lines; each labelled one is judged once, on its side of the split."""
    monkeypatch.setattr(session, "ROWS_OF_TASK", 1000)
    made = []
    monkeypatch.setattr(plans, "cut", lambda df: made.append(session.cut(df)) or made[-1])
    folder = "/root/testdata/sf0.01"
    got = {r.held_out: r.rows for r in driver.queries()["tfidf_accuracy"](spark, folder).collect()}
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    ids = [r.doc_id for r in docs.where("text is not null").join(labels, "doc_id").select("doc_id").collect()]
    held_out = sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in ids)
    assert got == {True: held_out, False: len(ids) - held_out}
    assert [d.rdd.getNumPartitions() for d in made] == [-(-8 * docs.where("text is not null").count() // 1000)] * 2
