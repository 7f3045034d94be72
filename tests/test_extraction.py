import random
import re

from pyspark.sql import functions as F

from tessera.functions import models, ontology, sentiment
from tessera.operators import history, queue

WORDS = tuple(w for a in ontology.ASPECTS for w in a[2])
ODD = ("a a", "x a a", "ſun", "σας", "straße", "İstanbul", "ıd", "kk", "µm", "_u", "a bb", "bb ccc", "a")


def by_patterns(text, words):
    found = sorted({m.span() for w in words for m in re.finditer(rf"(?<!\w){re.escape(w)}(?!\w)", text, re.I)}, key=lambda s: (s[0] - s[1], s))
    kept = []
    for a, b in found:
        if all(b <= c or a >= d for c, d in kept):
            kept.append((a, b))
    return sorted(kept)


def texts():
    rng = random.Random(2)
    letters = ["😀", " ", " ", "a", "A", "b", "c", "x", ".", "-", "_", "ſ", "S", "k", "K", "İ", "I", "i", "ı", "σ", "Σ", "ς", "ß", "µ", "μ", "é"]
    for i in range(1500):
        if i % 2:
            yield "".join(rng.choice(letters) for _ in range(rng.randint(0, 16)))
        else:
            yield "".join(rng.choice(["", " ", "😀 ", "İ ", "-", "_"]) + rng.choice([str.upper, str.lower, str.title, str])(rng.choice(WORDS + ODD)) for _ in range(rng.randint(0, 6)))
    yield "battery life " * 5000


def test_automaton_finds_what_patterns_find(spark):
    rows = list(texts())
    known = sentiment.Aliases(WORDS + ODD)
    for t in rows[:-1]:
        assert sentiment.longest_first(known.places(t)) == by_patterns(t, WORDS + ODD)
    assert len(sentiment.longest_first(known.places(rows[-1]))) == 5000
    df = spark.createDataFrame([*enumerate(rows), (-1, None)], "i int, t string").repartition(3)
    got = {r.i: r.s for r in df.select("i", sentiment.extract_aspects(F.col("t"), WORDS + ODD).alias("s")).collect()}
    assert got[-1] is None
    for i, t in enumerate(rows[:-1]):
        assert [(x.start_char, x.end_char) for x in got[i]] == by_patterns(t, WORDS + ODD)
        assert all(x.raw_aspect == t[x.start_char : x.end_char] and x.confidence == 0.8 for x in got[i])


def test_answers_whose_context_comes_again(spark):
    contexts = spark.createDataFrame([(1, "r", "good battery"), (1, "r", "good battery"), (1, "r", "other words"), (1, "s", None)], "k int, review_id string, text string")
    say = lambda q: f'{{"claims":[{{"text":"t","citations":[{{"review_id":"r","quote":"{q}"}}]}}]}}'
    rows = spark.createDataFrame([(1, say("battery")), (1, say("other")), (1, say("none")), (2, say("battery"))], "k int, output string")
    assert sorted(r.status for r in models.answers(rows, contexts, "k").collect()) == ["answered", "answered", "insufficient_evidence", "invalid"]


def test_every_worker_gets_a_job(spark):
    jobs = spark.range(1500).selectExpr("id job_id", "'queued' status", "cast(null as timestamp) lease_expires_at", "timestamp_seconds(id) created_at", "0 attempt", "'v1' pipeline_version")
    got = queue.claims(jobs, spark.range(1200).selectExpr("id worker_id"), F.lit("2024-01-01").cast("timestamp"), "v1")
    assert [(r.job_id, r.worker_id) for r in got.orderBy("job_id").collect()] == [(i, i) for i in range(1200)]


def test_first_offer_of_a_version(spark):
    offered = spark.createDataFrame([("a", "v", 2, "y"), ("a", "v", 1, "z"), ("b", "v", 1, "q"), ("c", "v", 5, "q")], "review_id string, pipeline_version string, at int, payload string")
    saved = spark.createDataFrame([("b", "v")], "review_id string, pipeline_version string")
    assert sorted(r.payload for r in history.new_versions(saved, offered, order=F.col("at")).collect()) == ["q", "z"]
    assert sorted(r.payload for r in history.new_versions(saved, offered).collect()) == ["q", "z"]
