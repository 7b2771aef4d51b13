"""JSON-lines sources: strict for training data, lenient for journals; datasets with a meta row; listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

META = "develop-meta"


class BadDataset(ValueError):
    """A dataset that must not be trained on."""


def strict(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Every line must parse: one that does not fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def lenient(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Lines that do not parse are dropped."""
    marked = StructType(list(schema.fields)).add("_bad", "string")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    lines = spark.read.text(path).filter(F.trim("value") != "").select(F.from_json("value", marked, options).alias("row")).select("row.*")
    return lines.filter(F.col("_bad").isNull()).drop("_bad")


def dataset(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, dict]:
    """(rows, meta) of a dataset whose last line is its meta row; one without is refused."""
    lines = strict(spark, path, StructType(list(schema.fields)).add("_type", "string").add("model", "string").add("dim", "integer"))
    meta = lines.filter(F.col("_type") == META).select("model", "dim").limit(2).collect()
    if len(meta) != 1:
        raise BadDataset(f"{path} has {len(meta)} meta rows")
    return lines.filter(F.col("_type").isNull()).select(*schema.fieldNames()), meta[0].asDict()


def merge_guard(a: dict, b: dict) -> None:
    """Two datasets can be joined only if they lie in one space."""
    differs = sorted(k for k in a.keys() | b.keys() if a.get(k) != b.get(k))
    if differs:
        raise BadDataset(f"the datasets differ in {', '.join(differs)}")


def write_dataset(rows: DataFrame, meta: dict, path: str) -> None:
    """rows and their meta row as JSON lines."""
    spark = rows.sparkSession
    body = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
    last = spark.createDataFrame([(META, meta["model"], meta["dim"])], "_type string, model string, dim int")
    body.unionByName(last.select(F.to_json(F.struct("_type", "model", "dim")).alias("value"))).write.text(path)


def listing(spark: SparkSession, root: str, extensions: tuple[str, ...] = ()) -> DataFrame:
    """(path, name, ext, size, mtime) of the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("ext", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)))
    found = named.filter(~F.col("name").startswith("."))
    return (found.filter(F.col("ext").isin(*extensions)) if extensions else found).select("path", "name", "ext", "size", "mtime")
