import numpy as np

from tessera.functions import models


def test_windows_that_are_null_or_empty(spark):
    rows = spark.createDataFrame([(1, ["battery", "x"]), (2, []), (3, None), (4, ["x", "keyboard", "display"])], "id int, tokens array<string>")

    def load():
        return lambda tokens: np.array([[0.0, 2.0] if len(t) > 6 else [1.0, 0.0] for t in tokens])

    got = {r.id: r.p for r in rows.coalesce(1).select("id", models.token_classifier(load, ("O", "B-ASP"))("tokens").alias("p")).collect()}
    assert got[2] == [] and got[3] is None
    assert [x.label for x in got[1]] == ["B-ASP", "O"] and [x.label for x in got[4]] == ["O", "B-ASP", "B-ASP"]
    assert abs(got[1][0].confidence - 1 / (1 + np.exp(-2))) < 1e-12 and abs(got[1][1].confidence - 1 / (1 + np.exp(-1))) < 1e-12
