import itertools

import pytest
from pyspark.sql import functions as F

from tessera.functions import ontology
from tessera.operators import reports, votes

M = "product_id string, review_id string, aspect_id string, sentiment string, confidence double, helpful_votes int"


def table(spark, rows):
    return spark.createDataFrame([("p", *r) for r in rows], M)


def ranked(spark, rows):
    return {r.aspect_id: r for r in votes.product_ranking(table(spark, rows)).collect()}


def votes_of(pos, neu, neg, aspect="battery"):
    labels = ["positive"] * pos + ["neutral"] * neu + ["negative"] * neg
    return [(f"r{i}", aspect, s, 0.8, 0) for i, s in enumerate(labels)]


def test_contradiction_is_a_neutral_vote(spark):
    got = ranked(spark, [("r1", "battery", "positive", 0.9, 0), ("r1", "battery", "negative", 0.7, 0), ("r2", "battery", "neutral", 0.8, 0), ("r3", "battery", "neutral", 0.8, 0)])["battery"]
    assert (got.neutral, got.positive, got.contradictory_review_count, got.classification, got.mention_count) == (3, 0, 1, "neutral", 4)


def test_confidence_is_the_least_of_all_mentions(spark):
    got = ranked(spark, [("r1", "battery", "positive", 0.95, 0), ("r1", "battery", "positive", 0.72, 0)])["battery"]
    assert (got.average_confidence, got.review_count, got.mention_count, got["rank"], got.aggregate_tag) == (0.72, 1, 2, None, None)


BOUNDS = [(4, 0, 1, "excellent"), (3, 2, 0, "good"), (1, 0, 4, "poor"), (0, 2, 3, "weak"), (2, 1, 2, "mixed"), (2, 0, 0, "insufficient_evidence"), (0, 3, 0, "neutral")]


def test_class_boundaries(spark):
    rows = spark.createDataFrame(BOUNDS, "p int, u int, n int, want string")
    assert rows.where(votes.classify(F.col("p"), F.col("u"), F.col("n")) != F.col("want")).count() == 0


def test_order_of_rows_does_not_matter(spark):
    rows = votes_of(3, 0, 0) + votes_of(3, 0, 0, "display")
    want = sorted(map(str, votes.product_ranking(table(spark, rows)).collect()))
    for p in itertools.islice(itertools.permutations(rows), 0, 720, 240):
        assert sorted(map(str, votes.product_ranking(table(spark, list(p)).repartition(3)).collect())) == want
    got = ranked(spark, rows)
    assert (got["battery"]["rank"], got["display"]["rank"]) == (1, 2)


def test_representatives(spark):
    m = table(spark, [("r0", "battery", "positive", 0.8, 99), ("r2", "battery", "positive", 0.9, 0), ("r1", "battery", "positive", 0.9, 1)])
    got = votes.representatives(votes.votes(m), m.select("product_id", "review_id", "helpful_votes"), 2).orderBy("place").collect()
    assert [r.review_id for r in got] == ["r1", "r2"]


def test_snapshot_fills_zeros(spark):
    m = table(spark, votes_of(2, 0, 0))
    reviews = spark.createDataFrame([("p", f"r{i}", 0) for i in range(5)] + [("q", "x", 0)], "product_id string, review_id string, helpful_votes int")
    got = {r.product_id: r for r in votes.snapshot(m, reviews).collect()}
    assert (got["p"].review_count, got["p"].positive, got["p"].insufficient_evidence_aspects) == (5, 2, ["battery"])
    assert (got["q"].review_count, got["q"].positive, got["q"].strengths_aspects) == (1, 0, [])


def test_saved_rows_are_checked(spark):
    for bad in [("r", "battery", "positive", 1.5, 0), ("r", "battery", "glad", 0.5, 0), ("r", "battery", "positive", float("nan"), 0)]:
        with pytest.raises(Exception, match="invalid saved mention"):
            votes.checked(table(spark, [bad])).collect()
    twice = spark.createDataFrame([("r", "a"), ("r", "a")], "review_id string, review_text string")
    assert votes.unique_reviews(twice).count() == 1
    with pytest.raises(Exception, match="conflicting"):
        votes.unique_reviews(twice.unionByName(twice.withColumn("review_text", F.lit("b")))).collect()


AUDIT = [((3, 0, 0), 0.0, 0.0, True), ((4, 0, 1), 0.2, 1.0, False), ((3, 2, 0), 0.4, 0.4, True), ((2, 0, 0), 1.0, 1.0, False)]


@pytest.mark.parametrize(("counts", "stability", "tag", "fragile"), AUDIT)
def test_leave_one_out(spark, counts, stability, tag, fragile):
    got = reports.leave_one_out(votes.product_ranking(table(spark, votes_of(*counts)))).first()
    assert (got.classification_stability, got.tag_stability, got.fragile_tag) == (pytest.approx(stability), pytest.approx(tag), fragile)


def side(spark, rows, version="v1"):
    return votes.product_ranking(table(spark, rows)).withColumn("pipeline_version", F.lit(version)).withColumn("pair", F.lit(1))


def test_comparison(spark):
    left, right = side(spark, votes_of(4, 0, 1) + votes_of(3, 0, 0, "ram")), side(spark, votes_of(2, 1, 2) + votes_of(2, 0, 0, "ports"))
    got = {r.aspect_id: r for r in reports.compare(left, right, ["pair", "aspect_id"]).collect()}
    assert got["battery"].difference == pytest.approx(0.6) and got["battery"].signal == "left"
    assert got["ram"].signal == got["ports"].signal == "insufficient_evidence" and got["ports"].right_gap
    same = reports.compare(left, left, ["pair", "aspect_id"])
    assert {r.signal for r in same.collect()} == {"tie"} and reports.verdict(same, ["pair"]).first().winner is None
    other = reports.compare(left, side(spark, votes_of(0, 0, 5), "v2"), ["pair", "aspect_id"])
    assert reports.verdict(other, ["pair"]).first().winner is None
    assert reports.verdict(reports.compare(left, right, ["pair", "aspect_id"]), ["pair"]).first().winner == "left"


TAG = "array<struct<normalized_aspect:string,normalized_aspect_id:string,sentiment:string,confidence:double>>"


def test_quality_queue(spark):
    rows = [
        ("b", "x", [(None, None, "positive", 0.5), ("Battery", "battery", "positive", 0.9)]),
        ("a", "x", []),
        ("z", "x", [("Battery", "battery", "positive", 0.9), ("BATTERY ", None, "negative", 0.9)]),
        ("ok", "x", [("Battery", "battery", "positive", 0.6)]),
        ("nan", "x", [("Battery", "battery", "positive", float("nan"))]),
    ]
    queue = reports.quality_queue(spark.createDataFrame(rows, f"review_id string, review_text string, tags {TAG}"))
    got = [(r.review_id, r.reasons) for r in reports.in_queue_order(queue).collect()]
    assert got == [("b", ["unknown_aspect", "low_confidence"]), ("a", ["no_aspects"]), ("z", ["contradictory_sentiment"])]
    assert dict(reports.reason_counts(queue).collect()) == {"unknown_aspect": 1, "low_confidence": 1, "no_aspects": 1, "contradictory_sentiment": 1}
    with pytest.raises(ValueError):
        reports.quality_queue(queue, 1.5)


def test_tags(spark):
    rows = spark.createDataFrame([("battery",), (" Build quality",), ("hinge",), ("",), (None,)], "a string")
    got = [r[0] for r in rows.select(ontology.generate_tag(F.col("a"), F.lit("negative"))).collect()]
    assert got == ["Poor Battery", "Poor Build Quality", None, None, None]
    for a, s in (("screen_size", "positive"), ("battery", "glad")):
        with pytest.raises(Exception, match="unknown canonical|invalid sentiment"):
            spark.range(1).select(ontology.generate_tag(F.lit(a), F.lit(s))).collect()
    own = spark.createDataFrame([(a, b, list(c)) for a, b, c in ontology.ASPECTS], "id string, label string, aliases array<string>")
    assert ontology.violations(own).count() == 0
    clash = own.unionByName(spark.createDataFrame([("x", "X", ["Battery"])], own.schema))
    assert [r.check for r in ontology.violations(clash).collect()] == ["alias_collision"]
