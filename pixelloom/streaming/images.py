"""An extension: images that arrive in a folder, as a stream of palettes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pixelloom.operators.clustering import palette
from pixelloom.sources.images import pixels, scan


def palettes(spark: SparkSession, folder: str, target: str, checkpoint: str, **how) -> StreamingQuery:
    """Writes the palette of each new image to ``target`` (Parquet). A batch that is run again replaces its own folder."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.{png,jpg,jpeg,PNG,JPG,JPEG}").load(folder).select("path")

    def batch(found: DataFrame, number: int) -> None:
        paths = [r.path for r in found.collect()]  # names of one batch
        if paths:
            images = scan(spark, paths)
            palette(pixels(images), **how).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
