import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import language_id, quality_pu, toxicity
from tessera.llm.learning import bounded, fold

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache(), spark.read.parquet(f"{SMALL}/labels.parquet").cache()


def test_languages_of_held_out_documents(tables, docs, empty):
    rows = tables[0]
    model = language_id.fit(rows.where(fold("doc_id", 4) != 2))
    got = language_id.predict(rows.where(fold("doc_id", 4) == 2), model).join(rows.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.98
    for r in language_id.predict(docs, model).join(docs.select("doc_id", "text"), "doc_id").where("doc_id not in (40, 41)").collect():
        lettered = any(c.isalpha() for c in r.text or "")
        assert lettered or (r.lang_pred, r.score) == ("und", 0.0)
        assert not lettered or (r.lang_pred != "und" and 0 < r.score <= 1)
    assert language_id.predict(empty, model).count() == 0
    nothing = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}


def test_two_languages_in_one_document(tables, spark):
    rows = tables[0]
    model = language_id.fit(rows)
    part = {lang: " ".join(r.text[:1500] for r in rows.where(F.col("lang") == lang).limit(4).collect()) for lang in ("en", "fr")}
    got = language_id.predict(spark.createDataFrame([(1, part["en"] + " " + part["fr"])], "doc_id long, text string"), model).first()
    assert {"en", "fr"} <= set(got.mixture) and sum(got.mixture.values()) == pytest.approx(1)


def test_mixture_does_not_depend_on_batch_neighbours():
    """A second language too weak to pay for itself, and a third that pays for both."""
    log = np.full((language_id.BUCKETS, 3), -5.0, np.float32)
    for c, row in zip("xyz", ((-1, -5, -5), (-2, -1.955, -5), (-5, -5, -1)), strict=True):
        log[language_id.trigrams(np.frombuffer(c.encode() * 3, np.uint8))[0]] = row
    model = language_id.Model(["a", "b", "c"], log)
    text = "x" * 640 + "y" * 384 + "z" * 192
    alone, _ = language_id.infer(model, pa.array([text]))
    beside, _ = language_id.infer(model, pa.array([text, "x" * 640 + "z" * 640]))
    assert (alone[0] == beside[0]).all() and (alone[0] > 0).sum() == 3


def test_quality_of_held_out_documents(tables, docs, empty):
    rows, labels = tables
    train = fold("doc_id", 5) != 0
    model = quality_pu.fit(rows.where(train), labels.where(train), 400, 600)
    got = quality_pu.score(rows, model).join(labels.where(~train), "doc_id").toPandas()
    assert ((got["score"] >= 0.3) == (got["quality"] == 1)).mean() > 0.85
    assert quality_pu.score(docs, model).where("score between 0 and 1").count() == docs.count()
    assert quality_pu.score(empty, model).count() == 0
    assert quality_pu.fit(rows, labels.limit(0)) is None
    assert {r.score for r in quality_pu.score(docs, None).collect()} == {0.5}


def test_prior_is_the_least_ratio():
    rng = np.random.default_rng(0)
    p = rng.normal(2, 1, 4000)
    u = np.concatenate([rng.normal(2, 1, 2800), rng.normal(-2, 1, 1200)])
    assert quality_pu.class_prior(p, u) == pytest.approx(0.7, abs=0.06)


def test_toxicity(tables, docs, empty, spark):
    rows, labels = tables
    languages = language_id.fit(rows)
    train = fold("doc_id", 5) != 0
    net = toxicity.fit(rows.where(train), labels.where(train), languages, 300)
    got = toxicity.score(rows, net, languages).join(labels.where(~train), "doc_id").toPandas()
    assert ((got["score"] >= 0.5) == (got["toxic"] == 1)).mean() > 0.85
    assert toxicity.score(docs, net, languages).where("score between 0 and 1").count() == docs.count()
    assert toxicity.score(empty, net, languages).count() == 0
    assert toxicity.fit(rows, labels.where("toxic = 0"), languages) is None
    assert {r.score for r in toxicity.score(docs, None, languages).collect()} == {0.0}


def test_thresholds_follow_the_true_share_of_toxic_rows(spark):
    """At the share of a balanced sample the best F1 would flag the common word, which 30 % of clean rows hold."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(4000):
        toxic = i % 33 == 0
        words = [f"word{x}" for x in rng.integers(0, 60, 20)]
        words += ["vile"] * (rng.random() < (0.9 if toxic else 0.3)) + ["awful"] * (toxic and rng.random() < 0.5)
        rows.append((i, " ".join(words), "en", int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").repartition(4)
    languages = language_id.fit(docs)
    net = toxicity.fit(docs, docs.select("doc_id", "toxic"), languages, 80)
    got = toxicity.score(docs, net, languages).join(docs.select("doc_id", "toxic"), "doc_id").toPandas()
    flagged = got["score"] >= 0.5
    assert flagged[got["toxic"] == 0].mean() < 0.05 and flagged[got["toxic"] == 1].mean() > 0.3


def test_word_rows_fold_case_and_punctuation():
    text = b"Word, (word) WORD!! -- other"
    got, first = toxicity.word_rows(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert first.tolist() == [0, 4] and (got[0] == got[1]).all() and (got[1] == got[2]).all() and (got[3] != got[0]).any()


def test_pooling_as_by_loop():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 500, (n, 2)).astype(np.int32) for n in (0, 1, 2, 7)]
    net = toxicity.train([d for d in docs[1:]] * 4, np.array([0.0, 1, 1] * 4), epochs=1)
    table = net.compiled()
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    together = net.logits(table, np.concatenate(docs), first)
    for d, z in zip(docs, together, strict=True):
        assert net.logits(table, d, np.array([0, len(d)]))[0] == pytest.approx(z, abs=1e-4)
        pooled = np.zeros(len(toxicity.WIDTHS) * toxicity.FILTERS)
        e = net.tables[0][d[:, 0]] + net.tables[1][d[:, 1]]
        for k, w in enumerate(toxicity.WIDTHS):
            for i in range(len(d) - w + 1):
                v = e[i : i + w].reshape(-1) @ net.filters[k] + net.bias[k]
                at = slice(k * toxicity.FILTERS, (k + 1) * toxicity.FILTERS)
                pooled[at] = np.maximum(pooled[at], v)
        assert pooled @ net.weight + net.offset == pytest.approx(z, abs=1e-3)


def test_samples_do_not_depend_on_partitions(spark):
    ids = spark.range(1000).withColumnRenamed("id", "doc_id")
    assert bounded(ids, 10, 1).collect() == bounded(ids.repartition(7), 10, 1).collect()
