import datetime as dt

from pyspark.sql import functions as F

from tidemark.llm.survivorship import survivors

T = dt.datetime(2024, 1, 1)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "g string, id string, p int, t timestamp, x double, y string, value string")
    got = survivors(df, ["g"], "id", F.col("p"), "t", {"x": F.when(F.col("x") > 0, F.col("x")), "y": F.col("y")}, **options)
    return {r.g: (r.x, r.x_from, r.y, r.y_from) for r in got.collect()}


def test_field_by_field(spark):
    h = dt.timedelta(hours=1)
    rows = [
        ("a", "1", 1, T, 5.0, None, ""), ("a", "2", 0, T, None, "best", ""), ("a", "3", 1, T + h, 6.0, "late", ""), ("a", "4", 0, T + h, -1.0, None, ""),
        ("b", "9", 0, T, 1.0, "q", ""), ("b", "9", 0, T, 1.0, "q", ""),
        ("c", "7", 0, None, 1.0, "n", ""), ("c", "8", 0, T, 2.0, "m", ""), ("c", "6", 0, T, 3.0, "k", ""),
        ("d", "1", 0, T, 0.0, None, ""), ("d", "2", 0, T, None, None, ""),
        (None, "1", 0, T, 1.0, "z", ""), (None, "2", 1, T, 2.0, "z", ""), ("e", None, 0, T, 1.0, "z", ""), ("e", "1", 0, T, 1.0, "z", ""),
    ]
    assert run(spark, rows) == {
        "a": (6.0, "3", "best", "2"),
        "c": (3.0, "6", "k", "6"),
        "d": (None, None, None, None),
        None: (1.0, "1", "z", "1"),
    }
    assert set(run(spark, rows, least_records=3)) == {"a", "c"}
    assert run(spark, []) == {}
