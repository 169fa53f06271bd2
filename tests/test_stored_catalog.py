"""An upsert of the stored catalog works out its batch once."""

from pyspark.sql import functions as F

from catalogkit.sources import catalog_table


def stored(spark, n):
    title = F.concat(F.lit("t"), F.col("id").cast("string"))
    return spark.range(n).select(F.lit("a").alias("artist"), F.lit("b").alias("album"), title.alias("title"), F.col("id").alias("seq"))


def test_a_batch_is_worked_out_once(spark, tmp_path):
    path, seen = str(tmp_path / "c"), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def watched(title):
        seen.add(1)
        return title

    catalog_table.refresh_catalog(stored(spark, 20), path, parts=4)
    batch = stored(spark, 30).withColumn("title", watched("title"))
    assert catalog_table.merge_into_catalog(spark, path, batch).count() == 30
    assert seen.value == 30
