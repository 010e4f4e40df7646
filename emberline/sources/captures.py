"""Publishing clean captures: write a version, then switch the pointer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.operators.validate import accepted_observations, validation_report
from emberline.session import cut_lineage

POINTER = T.StructType([T.StructField("version", T.LongType()), T.StructField("source", T.StringType()),
                        T.StructField("records_accepted", T.LongType())])


def current_version(spark: SparkSession, base: str) -> int | None:
    """Version of the newest published capture; None when there is none."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{base}/pointer")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(POINTER).json(f"{base}/pointer").agg(F.max("version")).first()[0]


def write_clean_capture(validated: DataFrame, base: str, source: str) -> int:
    """Raw rows, report and accepted rows of a capture as a new version.

    The pointer row is appended last, so readers see a whole capture or the one
    before. A capture without a valid row raises and leaves everything as it was.
    """
    spark = validated.sparkSession
    kept = cut_lineage(validated)
    report = cut_lineage(validation_report(kept))
    accepted = report.first()["records_accepted"]
    if accepted == 0:
        raise ValueError("no valid rows; the previous capture stays")
    version = (current_version(spark, base) or 0) + 1
    target = f"{base}/v{version}"
    inner = [c for c in kept.columns if c.startswith(("p_", "bad_", "missing_", "_")) or c == "row_order"]
    kept.drop(*inner).write.json(f"{target}/raw")
    report.write.json(f"{target}/report")
    accepted_observations(kept).write.json(f"{target}/clean")
    spark.createDataFrame([(version, source, accepted)], POINTER).write.mode("append").json(f"{base}/pointer")
    return version


def read_clean_capture(spark: SparkSession, base: str, schema: T.StructType) -> DataFrame:
    version = current_version(spark, base)
    if version is None:
        raise FileNotFoundError(f"no capture was published in {base}")
    return spark.read.schema(schema).json(f"{base}/v{version}/clean")
