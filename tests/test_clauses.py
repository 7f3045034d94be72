from pyspark.sql import functions as F

from tessera.functions import sentiment


def test_a_text_is_cut_into_clauses_once(spark, monkeypatch):
    """Mentions of a text that follow each other share its clauses; null spans and texts have none."""
    text = "Dr. Low likes the screen, but the battery is bad. Fine!"
    seen = []
    cut = sentiment._clauses
    monkeypatch.setattr(sentiment, "_clauses", lambda t: seen.append(t) or cut(t))
    import pyarrow as pa

    got = sentiment.clause_context.func(pa.array([text, text, text, None, text]), pa.array([18, 34, 18, 0, None], pa.int32()), pa.array([24, 41, 41, 1, 3], pa.int32())).to_pylist()
    assert [g["context"] for g in got] == ["Dr. Low likes the screen,", "the battery is bad", text, None, None]
    assert [(g["start_char"], g["end_char"]) for g in got[:3]] == [(0, 25), (30, 48), (0, len(text))] and seen == [text]


def test_lexicon_of_null_and_odd_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "not good"), (4, "good good bad"), (5, "never bad")], "id int, t string")
    s = sentiment.lexicon_sentiment(F.col("t"))
    got = {r.id: (r.s.label, r.s.confidence) for r in rows.select("id", s.alias("s")).collect()}
    assert got == {1: ("neutral", 0.5), 2: ("neutral", 0.5), 3: ("negative", 0.72), 4: ("positive", 0.84), 5: ("positive", 0.72)}
