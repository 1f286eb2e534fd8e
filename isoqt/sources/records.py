"""Record files: inventory and header comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Metadata files, the most wanted first (fixed values).
METADATA_FILES = ["ptbxl_database.csv", "exams.csv", "RECORDS"]


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, dir, stem, ext of every file below ``root``; hidden folders are skipped.

    The file content is never read.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path"))
    return split_paths(files).filter(~F.col("path").rlike(r"/\.[^/]+/"))


def split_paths(files: DataFrame) -> DataFrame:
    """Cut a ``path`` column into dir, name, stem and lower-case ext."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        "path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), name.alias("name"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"),
        F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("ext"))


def extension_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("ext").agg(F.count(F.lit(1)).alias("n"))


def records(files: DataFrame) -> DataFrame:
    """Headers (.hea) with a data file (.dat or .mat) of the same folder and stem, ignoring case."""
    keyed = files.withColumn("key", F.lower("stem"))
    data = keyed.filter(F.col("ext").isin(".dat", ".mat")).select("dir", "key")
    return (keyed.filter(F.col("ext") == ".hea").join(data, ["dir", "key"], "left_semi")
            .select(F.concat_ws("/", "dir", "stem").alias("record_path"), "dir", "stem"))


def metadata_file(files: DataFrame) -> DataFrame:
    """The most wanted metadata file present."""
    rank = F.array_position(F.array(*[F.lit(x) for x in METADATA_FILES]), F.col("name"))
    return files.filter(rank > 0).agg(F.min_by("path", F.struct(rank, "path")).alias("path"))


def detect_format(counts: DataFrame, name: str) -> DataFrame:
    """'hdf5' for code datasets with .hdf5 files, 'wfdb' with .hea files, else 'unknown'."""
    wide = counts.agg(F.max(F.when(F.col("ext") == ".hdf5", F.col("n"))).alias("h5"),
                      F.max(F.when(F.col("ext") == ".hea", F.col("n"))).alias("hea"))
    return wide.select(F.when((F.col("h5") > 0) & F.lit("code" in name.lower()), "hdf5")
                       .when(F.col("hea") > 0, "wfdb").otherwise("unknown").alias("format"))


# ---- header comments ----------------------------------------------------------------------
def read_headers(spark: SparkSession, paths) -> DataFrame:
    """Age, sex and SNOMED codes from the comment lines of header files."""
    text = spark.read.text(paths, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return parse_headers(text.select("path", F.col("value").alias("header")))


def parse_headers(df: DataFrame, header: str = "header") -> DataFrame:
    """Add age (double), sex (0/1) and codes (all-digit entries only)."""
    def field(pattern: str) -> Column:
        return F.regexp_extract(header, rf"(?im)^\s*#\s*{pattern}", 1)
    sex = F.lower(field(r"Sex[:\s]+(\w+)"))
    dx = field(r"Dx[:\s]+(.+)$")
    return df.withColumns({
        "age": field(r"Age[:\s]+(\d+)").try_cast("double"),
        "sex": F.when(sex.isin("male", "m", "0"), 0).when(sex.isin("female", "f", "1"), 1),
        "codes": F.filter(F.split(dx, r"[,\s]+"), lambda c: c.rlike("^[0-9]+$")),
    })


def has_coded_headers(df: DataFrame, header: str = "header") -> DataFrame:
    """True if any header has a numeric Dx."""
    hit = F.col(header).rlike(r"(?i)#\s*Dx[:\s]+\d+")
    return df.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("has_coded_headers"))
