"""Table scans and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isoqt.functions.clean import finite, number
from isoqt.operators.schema import pool, sample_n

# Separator and decimal sign per dialect (fixed values).
DIALECTS = {"eu": (";", ","), "std": (",", ".")}


def first_existing(spark: SparkSession, paths) -> str:
    """First path of an ordered list that exists (any Hadoop file system, globs allowed)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in [paths] if isinstance(paths, str) else paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        found = where.getFileSystem(conf).globStatus(where)
        if found is not None and len(found) > 0:
            return path
    raise FileNotFoundError(f"none of {paths}")


def read_delimited(spark: SparkSession, paths, dialect: str = "auto", numeric=None) -> DataFrame:
    """CSV in the European (;/,) or standard (,/.) dialect; 'auto' looks at the header line.

    All columns arrive as text; those named in ``numeric`` become doubles, with bad text as null.
    Without names one scan finds the columns that hold nothing but numbers: whole ones become bigint, others double.
    Numbers with leading zeros or more than 18 digits are ids and stay text, like columns without any value.
    """
    path = first_existing(spark, paths)
    if dialect == "auto":
        header = spark.read.text(path).first()
        dialect = "eu" if header and header[0].count(";") >= max(1, header[0].count(",")) else "std"
    sep, decimal = DIALECTS[dialect]
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    if numeric is None:
        checks = [kind_of(F.col(f"`{c}`"), number(f"`{c}`", decimal)).alias(c) for c in raw.columns]
        kinds = raw.agg(*checks).first().asDict()
        numeric = [c for c in raw.columns if kinds[c] == "double"]
        raw = raw.withColumns({c: F.trim(f"`{c}`").cast("bigint") for c in raw.columns if kinds[c] == "bigint"})
    return raw.withColumns({c: number(f"`{c}`", decimal) for c in numeric})


def kind_of(text: Column, value: Column) -> Column:
    """Aggregate: the type that holds every ``text`` of a column without loss, given its numeric ``value``."""
    plain = F.trim(text)
    an_id = F.bool_or(plain.rlike(r"^[+-]?(?:0[0-9]|[0-9]{19})"))
    return (F.when((F.count(text) == 0) | an_id | F.bool_or(text.isNotNull() & value.isNull()), "string")
            .when(F.bool_and(plain.rlike(r"^[+-]?[0-9]+$")), "bigint").otherwise("double"))


def read_table(spark: SparkSession, path: str, schema=None, partitions: int | None = None) -> DataFrame:
    """Parquet, JSON or CSV by suffix (.csv.gz too); NaN and infinities become null.

    One gzip file cannot be split, so it is spread over ``partitions`` tasks after reading.
    """
    name = path.rstrip("/").lower()
    if name.endswith((".csv", ".csv.gz")):
        reader = spark.read.option("header", True)
        df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
        if name.endswith(".gz"):
            df = df.repartition(partitions or spark.sparkContext.defaultParallelism)
    elif name.endswith((".json", ".jsonl")):
        df = spark.read.schema(schema).json(path) if schema else spark.read.json(path)
    else:
        df = spark.read.parquet(path)
    return no_nan(df)


def no_nan(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: finite(f"`{c}`") for c in floats}) if floats else df


def load_pool(datasets: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Union of the datasets tagged with their name, and the row count of each."""
    if not datasets:
        raise ValueError("no datasets")
    pooled = pool([df.withColumn("dataset", F.lit(name)) for name, df in datasets.items()])
    return pooled, pooled.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


def read_manifest(spark: SparkSession, path: str, root: str, n: int | None = None, column: str = "path") -> DataFrame:
    """Record paths of a manifest; the limit comes before the paths are built."""
    rows = spark.read.option("header", True).csv(path).select(column)
    rows = rows.limit(n) if n is not None else rows
    return rows.select(F.concat_ws("/", F.lit(root.rstrip("/")), F.col(column)).alias("record_path"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", dialect: str = "std", mode: str = "overwrite",
                partition_by=None) -> None:
    """Parquet, JSON or CSV; the European CSV has ';' between columns and ',' in numbers."""
    writer_input, options = df, {}
    if fmt == "csv":
        sep, decimal = DIALECTS[dialect]
        options = {"header": "true", "sep": sep}
        if decimal != ".":
            floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
            writer_input = df.withColumns({c: F.replace(F.col(f"`{c}`").cast("string"), F.lit("."), F.lit(","))
                                           for c in floats})
    writer = writer_input.write.mode(mode).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)


def compact(spark: SparkSession, parts: str, target: str, rows_per_file: int = 5_000_000) -> DataFrame:
    """Merge many small Parquet parts into files of a bounded row count at a new path.

    The target must not exist yet. Only the files that were read are removed, after the merged table has been written
    and counted; parts that arrive meanwhile stay.
    """
    before = spark.read.parquet(parts)
    read = before.inputFiles()
    before.write.mode("error").option("maxRecordsPerFile", rows_per_file).parquet(target)
    merged = spark.read.parquet(target)
    if merged.count() != before.count():
        raise RuntimeError("merged table differs from its parts; parts kept")
    for file in read:
        where = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file))
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, False)
    return merged


def flatten_report(df: DataFrame, key: str | None = None, name: str = "name") -> DataFrame:
    """Flat rows of a nested report: nested fields are dropped; with ``key`` naming a map column,
    one row per entry and only the plain fields of its struct."""
    nested = (T.StructType, T.MapType, T.ArrayType)
    if key is not None:
        value = df.schema[key].dataType.valueType
        plain = [f.name for f in value if not isinstance(f.dataType, nested)]
        entries = df.select(F.explode(F.map_entries(key)).alias("e"))
        return entries.select(F.col("e.key").alias(name), *[F.col(f"e.value.{c}").alias(c) for c in plain])
    return df.select(*[f.name for f in df.schema if not isinstance(f.dataType, nested)])


def sample_export(df: DataFrame, n: int = 50_000, cols=None, keys=("ecg_id",), seed: int = 42) -> DataFrame:
    """Fixed-size seeded sample without replacement of chosen columns; no task orders the sample."""
    cols = list(cols or df.columns)
    return sample_n(df.select(*dict.fromkeys([*cols, *keys])), n, keys, seed=seed).select(*cols)


def route_errors(df: DataFrame, reason) -> tuple[DataFrame, DataFrame]:
    """Processed rows and (ecg_id, error) rows, by a reason column that is null for good rows."""
    tagged = df.withColumn("error", reason)
    good = tagged.filter(F.col("error").isNull()).drop("error")
    return good, tagged.filter(F.col("error").isNotNull()).select("ecg_id", "error")


def record_error(min_beats: int = 3):
    """Why a record cannot be used, or null."""
    return (F.when(F.col("n_beats").isNull() | (F.col("n_beats") < min_beats), "Too few R-peaks")
            .when(F.col("rr_ms").isNull(), "No RR interval")
            .when(F.col("qt_ms").isNull(), "No QT interval"))
