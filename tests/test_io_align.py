"""CSV reading with non-strict casts, schema alignment, date parts."""

import datetime
import os

from pyspark.sql import types as T

from searchrank.functions.dates import preprocess
from searchrank.operators import align
from searchrank.sources import searchlog


def test_read_search_log_non_strict(spark, scratch):
    path = os.path.join(scratch, "train.csv")
    with open(path, "w") as f:
        f.write("srch_id,date_time,site_id,prop_id,price_usd,prop_review_score,booking_bool,extra\n")
        f.write("1,2013-04-04 08:32:15,12,100,104.77,NULL,1,keep\n")
        f.write("2,not a date,300,101,3.7,4.5,0,x\n")
        f.write("3,2013-06-30 19:00:00,3.7,102,NULL,2.0,NULL,y\n")
    df = searchlog.read_search_log(spark, path, is_train=True)
    types = {f.name: f.dataType for f in df.schema.fields}
    assert types["srch_id"] == T.LongType() and types["site_id"] == T.ByteType()
    assert types["price_usd"] == T.FloatType() and types["date_time"] == T.TimestampNTZType()
    assert types["extra"] == T.StringType()
    rows = {r["srch_id"]: r for r in df.collect()}
    assert rows[1]["date_time"] == datetime.datetime(2013, 4, 4, 8, 32, 15)
    assert rows[1]["prop_review_score"] is None
    assert rows[2]["date_time"] is None          # bad date -> NULL
    assert rows[2]["site_id"] is None            # 300 does not fit a tinyint
    assert rows[3]["site_id"] is None            # '3.7' is not an integer
    assert rows[3]["price_usd"] is None and rows[3]["booking_bool"] is None
    assert abs(rows[2]["price_usd"] - 3.7) < 1e-6


def test_align_rules(spark):
    a = spark.createDataFrame([(1, 2, "x", 1.5)], "id long, n int, s string, only_a double")
    b = spark.createDataFrame([(2, 3.5, 7, True)], "id long, n double, s int, only_b boolean")
    a2, b2 = align.align_columns(a, b)
    assert a2.columns == b2.columns == ["id", "n", "only_a", "only_b", "s"]
    t = {f.name: f.dataType for f in a2.schema.fields}
    assert t["id"] == T.LongType() and t["n"] == T.DoubleType() and t["s"] == T.StringType()
    assert t["only_a"] == T.DoubleType() and t["only_b"] == T.BooleanType()
    u = align.align_union(a, b).orderBy("id").collect()
    assert [r["s"] for r in u] == ["x", "7"]
    assert u[0]["only_b"] is None and u[1]["only_a"] is None


def test_iso_weekday_and_hour(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 7, 23, 5),), (datetime.datetime(2024, 1, 8, 0, 1),)],
                               "date_time timestamp_ntz")
    rows = preprocess(df).collect()
    assert [(r["hour"], r["dow"]) for r in rows] == [(23, 7), (0, 1)]  # Sunday = 7, Monday = 1
    assert "date_time" not in preprocess(df).columns


def test_nan_text_is_missing(spark):
    df = spark.createDataFrame([("NaN", "1"), ("2.5", "2")], "price_usd string, srch_id string")
    assert sorted(map(tuple, searchlog.apply_dtypes(df).collect()), key=str) == [(2.5, 2), (None, 1)]


def test_checkpoint_folder_must_be_named_on_a_cluster():
    import pytest

    from searchrank import session

    class Conf:
        def get(self, *_):
            return None

    class Fake:
        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getCheckpointDir():
                return None

            @staticmethod
            def getConf():
                return Conf()
        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Fake())
