"""A clear difference over many cells has a vanishing p; a series of 200 terms would give 1 here."""

from cellspan.operators import study


def test_tail_of_many_cells(spark):
    rows = [("a", "b", 0.1 + k / 1e4 if k else -0.01) for k in range(1500)]
    got = study.signed_ranks(spark.createDataFrame(rows, "model_a string, model_b string, d double"), ["model_a", "model_b"]).first()
    assert got["m"] == 1500 and 0 <= got["p"] < 1e-200
