from pyspark.sql import functions as F

from phraseloom import session


def test_the_cluster_names_the_folder(spark, tmp_path):
    before = spark.conf.get("spark.checkpoint.dir", None)
    try:
        spark.conf.set("spark.checkpoint.dir", f"file://{tmp_path}")
        df = session.materialize(spark.range(5).withColumn("x", F.col("id") * 2))
        assert str(tmp_path) in df.inputFiles()[0] and df.agg(F.sum("x")).first()[0] == 20
    except Exception as e:  # a static setting in this Spark version
        assert "CANNOT_MODIFY" in str(e)
    finally:
        if before is not None and spark.conf.get("spark.checkpoint.dir", None) != before:
            spark.conf.set("spark.checkpoint.dir", before)


def test_written_tables_keep_types_and_empty_rows(spark):
    df = spark.createDataFrame([], "a array<int>, b struct<x:bigint>, c string")
    got = session.materialize(df)
    assert got.schema == df.schema and got.count() == 0
