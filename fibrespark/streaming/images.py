"""Images as they arrive: a folder is watched, each batch of images is analysed and appended; running angle counts per image over a stream of fibers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fibrespark.plans.pipeline import AnalysisParameters, analyze_images
from fibrespark.sources.readers import decode_images


def watch_images(spark: SparkSession, path: str, glob: str = "*.tif") -> DataFrame:
    """A stream of the image files of a folder (path, modificationTime, length, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(path)


def analyze_stream(files: DataFrame, parameters: AnalysisParameters, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes each batch's feature table under its batch number, so a batch that runs again replaces its own output: each image counts once."""

    def batch(rows: DataFrame, number: int) -> None:
        images = decode_images(rows).where("error IS NULL")
        features = analyze_images(images, parameters).features
        features.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def running_histogram(fibers: DataFrame, step: float = 5.0) -> DataFrame:
    """Counts per image and bin of angle over a stream of fibers (image_id, angle); for update or complete mode."""
    return fibers.groupBy("image_id", F.floor(F.col("angle") / step).cast("int").alias("bin")).count()
