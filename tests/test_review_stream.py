import hashlib
import random
from collections import Counter

import pytest

from tessera.operators import review_stream

REVIEW = "place long, row_ok boolean, product string, own_id string, text string, time string, rating double, helpful string"
META = "place long, row_ok boolean, product string, title string, categories array<string>, brand string, details string"


def loop(rows, pool, cap):
    """The sequential rule, one row after the other."""
    by_product, seen, out = Counter(), set(), {}
    for place, ok, product, own, text, time, rating, _ in rows:
        if not ok:
            reason = "malformed"
        elif product not in pool:
            reason = "outside_pool"
        elif not (text or "").strip():
            reason = "missing_text"
        elif time is None:
            reason = "missing_timestamp"
        elif rating is None or not 1 <= rating <= 5:
            reason = "invalid_rating"
        else:
            rid = own.strip() if own and own.strip() else hashlib.sha256(f"{product}\0{time}\0{text}".encode()).hexdigest()
            reason = "duplicate" if rid in seen else "over_cap" if by_product[product] >= cap else None
            if reason is None:
                seen.add(rid)
                by_product[product] += 1
        out[place] = reason
    return out


def stream(rng, n, products, ids):
    hot = lambda k: 0 if rng.random() < 0.35 else rng.randrange(k)  # noqa: E731  one key holds a third of all rows
    return [
        (
            i, rng.random() > 0.03, rng.choice(["Z", None]) if rng.random() < 0.05 else f"P{hot(products)}", f"r{hot(ids)}" if rng.random() < 0.8 else rng.choice([None, " "]),
            rng.choice(["good", "bad", "fine", " ", None]), rng.choice(["1", "2", None]) if rng.random() < 0.3 else str(rng.randrange(9)), rng.choice([0.0, 1.0, 3.0, 5.0, 5.0, None]), rng.choice(["3", "-1", "x", None]),
        )
        for i in range(n)
    ]


@pytest.mark.parametrize(("n", "products", "ids", "cap"), [(400, 6, 60, 4), (400, 12, 300, 3), (300, 3, 20, 100), (200, 40, 40, 1), (0, 1, 1, 1)])
def test_as_by_the_loop(spark, n, products, ids, cap):
    rng = random.Random(n + products)
    rows = stream(rng, n, products, ids)
    pool = spark.createDataFrame([(f"P{i}",) for i in range(products)], "product string")
    got = review_stream.judged(spark.createDataFrame(rows, REVIEW).repartition(5), pool, cap)
    assert {r.place: r.reason for r in got.collect()} == loop(rows, {f"P{i}" for i in range(products)}, cap)


def test_ids_that_push_each_other_out(spark):
    """Each id offers its next product when it is turned away, which pushes out a later one there, and so on."""
    n = 6
    offers = [(f"r{i}", f"p{i}", 100 + i) for i in range(n)] + [(f"r{i}", f"p{i + 1}", 200 - i) for i in range(n)] + [("first", "p0", 1)]
    want, full, seen = set(), set(), set()
    for rid, product, place in sorted(offers, key=lambda x: x[2]):
        if rid not in seen and product not in full:
            want.add((rid, product, place))
            seen.add(rid)
            full.add(product)
    got = review_stream.held_offers(spark.createDataFrame(offers, "review_id string, product string, place long"), 1)
    assert {tuple(r[c] for c in ("review_id", "product", "place")) for r in got.collect()} == want


def test_caps_keep_rows_on_both_sides_of_the_shuffle(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    best = spark.range(1000).selectExpr("string(id % 3) product", "id place")
    plan = best.withColumn("n", F.row_number().over(Window.partitionBy("product").orderBy("place"))).where("n <= 5")._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_sample_and_counters(spark):
    laptop = lambda p, place, title="Acme Laptop 15", cats=("Electronics", "Laptops"), **k: (place, True, p, title, list(cats), k.get("brand"), k.get("details"))
    meta = [
        laptop(" L1 ", 1, details='{"Brand": "Acme"}'), laptop("L2", 2), laptop("L3", 3), laptop("BAG", 4, "Laptop bag", ("Laptops", "Bags")), laptop(None, 5), (6, False, None, None, None, None, None), laptop("L1", 7, "Other Laptop"),
    ]
    say = lambda i, p, t, time="1", **k: (i, True, p, k.get("own"), t, time, 5.0, k.get("helpful", "1"))
    reviews = [
        say(1, "L1", "Great display"), say(2, "L1", "Great display"), say(3, "L1", "Good battery", helpful="-2"), say(4, "L1", "Solid keys"), say(5, "L1", "Over the cap"), say(6, "L2", "Great screen"),
        say(7, "L3", ""), say(8, "BAG", "Nice bag"), say(9, "L3", "No clock", None), (10, False, None, None, None, None, None, None),
    ]
    rows, counters = review_stream.sample(spark.createDataFrame(meta, META), spark.createDataFrame(reviews, REVIEW), 2, 3, 250)
    got = sorted(rows.collect(), key=lambda r: (r["rank"], r.place))
    assert [(r["rank"], r.product, r.text, r.helpful_votes) for r in got] == [(1, "L1", "Great display", 1), (1, "L1", "Good battery", 0), (1, "L1", "Solid keys", 1), (2, "L2", "Great screen", 1)]
    assert (got[0].brand, got[0].name) == ("Acme", "Acme Laptop 15")
    said = {r.counter: r.rows for r in counters.collect()}
    want = {"metadata_rows_scanned": 7, "metadata_malformed": 1, "metadata_missing_product": 1, "metadata_non_laptop": 1, "metadata_duplicate_product": 1, "metadata_taken": 3, "reviews_duplicate": 1, "reviews_over_cap": 1, "reviews_missing_text": 1, "reviews_missing_timestamp": 1, "reviews_outside_pool": 1, "reviews_malformed": 1, "reviews_taken": 4, "reviews_rows_scanned": 10, "reviews_invalid_helpful_votes": 1, "candidate_products": 3, "selected_products": 2, "selected_products_with_three_reviews": 1, "selected_reviews": 4}
    assert said == want
    with pytest.raises(ValueError):
        review_stream.sample(spark.createDataFrame(meta, META), spark.createDataFrame(reviews, REVIEW), 51)
    with pytest.raises(ValueError):
        review_stream.judged(spark.createDataFrame(reviews, REVIEW), spark.createDataFrame([("L1",)], "product string"), 101)
