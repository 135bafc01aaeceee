from pyspark.sql import functions as F

from loadloom.operators.aggregates import wilson


def test_wilson_stays_within_bounds_and_says_nothing_of_nothing(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (0.0, 5.0), (5.0, 5.0), (3.0, 10.0)], "k double, n double")
    got = [tuple(round(x, 6) for x in r) for r in rows.select(*wilson(F.col("k"), F.col("n"))).collect()]
    assert got[0] == (0.0, 1.0) and got[1][0] == 0.0 and got[2][1] == 1.0
    middle, half, scale = 0.3 + 1.96**2 / 20, 1.96 * (0.3 * 0.7 / 10 + 1.96**2 / 400) ** 0.5, 1 + 1.96**2 / 10
    assert got[3] == (round((middle - half) / scale, 6), round((middle + half) / scale, 6))
