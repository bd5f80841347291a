"""Pixel tables: derived from the driver's tables, or from decoded images (images.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tile8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, x, y, v: one 8x8 tile of each 64-element embedding."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return e.select(F.col("vec_id").alias("image_id"), (F.col("pos") % 8).cast("int").alias("x"), F.floor(F.col("pos") / 8).cast("int").alias("y"), F.col("v").cast("double").alias("v"))


def mosaic64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, x, y, r, g, b: 64x64 images, a row of each channel an embedding."""
    t = tile8(spark, sf_dir)
    q = t.select(
        F.floor(F.col("image_id") / 192).cast("bigint").alias("id"),
        (F.col("y") * 8 + F.col("x")).cast("int").alias("x"),
        (F.col("image_id") % 64).cast("int").alias("y"),
        F.floor((F.col("image_id") % 192) / 64).cast("int").alias("ch"),
        F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("v") + 0.6) / 1.2 * 256))).cast("int").alias("u8"),
    )
    channel = lambda k, n: F.max(F.when(F.col("ch") == k, F.col("u8"))).alias(n)
    g = q.groupBy(F.col("id").alias("image_id"), "x", "y").agg(channel(0, "r"), channel(1, "g"), channel(2, "b"), F.count(F.lit(1)).alias("n"))
    return g.where("n = 3").drop("n")


def pixel_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, idx, r, g, b: images without coordinates, one a supplier: their number grows with the scale factor, their size doesn't."""
    li = table(spark, sf_dir, "lineitem")
    image = F.col("l_suppkey")
    w = Window.partitionBy(image).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return li.select(
        image.cast("bigint").alias("image_id"),
        (F.row_number().over(w) - 1).cast("bigint").alias("idx"),
        (F.col("l_quantity") * 5).cast("int").alias("r"),
        (F.round(F.col("l_discount") * 100) * 25).cast("int").alias("g"),
        (F.round(F.col("l_tax") * 100) * 31).cast("int").alias("b"),
    )


def scenes(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    """image_id, x, y, r, g, b: two flat blocks, a noisy pixel, a disc, a gradient; 32x32 each, four more for every hundred suppliers."""
    many = 4 * max(1, table(spark, sf_dir, "supplier").count() // 100) if sf_dir else 4
    p = spark.range(1024 * many).select(F.floor(F.col("id") / 1024).cast("bigint").alias("image_id"), (F.col("id") % 32).cast("int").alias("x"), F.floor(F.col("id") % 1024 / 32).cast("int").alias("y"))
    s, x, y = F.col("image_id") % 4, F.col("x"), F.col("y")
    disc = F.pow(x - 16, F.lit(2)) + F.pow(y - 17, F.lit(2)) <= 64
    pick = lambda a, b, c, d: F.when(s == 0, a).when(s == 1, b).when(s == 2, c).otherwise(d).cast("int")
    left = x < 16
    return p.select(
        "image_id", "x", "y",
        pick(F.when(left, 240).otherwise(70), F.lit(220) + F.when((x == 16) & (y == 16), 5).otherwise(0), F.when(disc, 200).otherwise(235), x * 8).alias("r"),
        pick(F.when(left, 80).otherwise(110), F.lit(220), F.when(disc, 40).otherwise(235), y * 8).alias("g"),
        pick(F.when(left, 90).otherwise(230), F.lit(230), F.when(disc, 60).otherwise(240), F.lit(128)).alias("b"),
    )
