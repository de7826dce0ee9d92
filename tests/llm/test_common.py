import os
import zlib

from pyspark.sql import functions as F

from docquarry.llm import common


def test_cut_and_drop(spark):
    df = common.cut(spark.range(5), "numbers")
    folder = common.shared_dir(spark).removeprefix("file://") + f"/docquarry-{spark.sparkContext.applicationId}"
    assert df.count() == 5 and os.path.isdir(folder)
    common.drop_scratch(spark)
    assert not os.path.exists(folder)


def test_folds(spark):
    ids = [0, 7, -3, 123456789, None]
    got = spark.createDataFrame([(i,) for i in ids], "i long").select("i", common.fold(F.col("i"), 5).alias("f")).collect()
    assert all(r.f == common.fold_of(r.i, 5) for r in got)
    assert common.fold_of(7, 5) == zlib.crc32(b"7") % 5 and common.fold_of(None, 3) == 0


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2)], "_H int, __h int")
    assert common.fresh(df, "_h") == "___h"
