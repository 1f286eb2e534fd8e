"""Joins of records with features, metadata, diagnoses and outcomes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from isoqt.fixed_values import JOIN_KEY_CANDIDATES
from isoqt.functions.clean import numeric_id
from isoqt.operators.schema import dedup
from isoqt.session import small_side, written


def merge_features(waves: DataFrame, features: DataFrame, key: str = "ecg_id", extra=()) -> DataFrame:
    """Left join of the demographic, label and ``extra`` columns the left side does not have yet.

    The right side is made unique first, so the row count of the left side is kept.
    """
    wanted = ["age", "sex", "superclass", *extra, *[c for c in features.columns if c.startswith("label_")]]
    add = [c for c in wanted if c in features.columns and c not in waves.columns]
    right = dedup(features.select(key, *add), [key], [*add])
    return waves.join(right, key, "left")


def match_report(merged: DataFrame, cols=("superclass", "age")) -> DataFrame:
    """Matched rows and percentage per merged column."""
    present = [c for c in cols if c in merged.columns]
    counts = merged.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in present])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("matched")) for c in present])
    return (counts.select("n", F.explode(rows).alias("m")).select("n", "m.*")
            .withColumn("match_pct", F.try_divide(100.0 * F.col("matched"), F.col("n"))))


def join_first_common(left: DataFrame, right: DataFrame, keys=JOIN_KEY_CANDIDATES, cols=None) -> DataFrame:
    """Left join on the first candidate key both sides have; without one the left side stays."""
    key = next((k for k in keys if k in left.columns and k in right.columns), None)
    if key is None:
        return left
    add = [c for c in (cols or right.columns) if c in right.columns and c not in left.columns]
    return left.join(dedup(right.select(key, *add), [key], [*add]), key, "left") if add else left


def lookup_demographics(df: DataFrame, meta: DataFrame, key: str = "ecg_id", cols=("age", "sex")) -> DataFrame:
    """Age and sex by record id; the metadata is broadcast only if its counted size allows."""
    side = small_side(dedup(meta.select(key, *cols), [key], list(cols)))
    return df.drop(*[c for c in cols if c in df.columns]).join(side, key, "left")


#: Longest piece (in bytes) by which a name is looked up in file names; longer names share a piece with their files and are verified.
PIECE = 8
#: Bits of the filter of the names' pieces; its size does not grow with the data.
FILTER_BITS = 1 << 26


def windows(text: pa.Array, sizes):
    """(size, row, piece) of all runs of each of ``sizes`` bytes inside the texts: the bytes themselves, as one number."""
    text = text.cast(pa.binary()).cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    if offsets[-1] == offsets[0]:
        return
    data = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    row = np.repeat(np.arange(len(text)), np.diff(offsets))
    room = (offsets[1:] - offsets[0])[row] - np.arange(len(data))
    piece = data
    for size in range(1, min(PIECE, len(data)) + 1):
        piece = piece if size == 1 else (piece[:-1] << np.uint64(8)) | data[size - 1 :]
        if size in sizes:
            at = np.flatnonzero(room[: len(piece)] >= size)
            yield size, row[at], piece[at]


def spots(piece: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a piece in the filter."""
    h = (piece ^ np.uint64(size * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return (h & np.uint64(FILTER_BITS - 1)).astype(np.int64), (h >> np.uint64(64 - (FILTER_BITS.bit_length() - 1))).astype(np.int64)


def with_pieces(batch: pa.RecordBatch, rows: list, *columns: list) -> pa.RecordBatch:
    """Rows of the batch with numbers beside them."""
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    out = batch.take(pa.array(join(rows), pa.int64()))
    return pa.RecordBatch.from_arrays([*out.columns, *[pa.array(join(c), pa.int64()) for c in columns]],
                                      names=[*batch.schema.names, "__size", "__piece", "__spot1", "__spot2"][: batch.num_columns + len(columns)])


def with_longs(df: DataFrame, *columns: str) -> StructType:
    return StructType([*df.schema.fields, *[StructField(c, LongType()) for c in columns]])


def own_pieces(names: DataFrame, name: str) -> DataFrame:
    """(name, size, piece and its bits): a name of at most ``PIECE`` bytes is its own piece, a longer one has all its pieces of that size."""

    def run(batches):
        for batch in batches:
            length = pc.binary_length(batch.column(0).cast(pa.binary())).to_numpy(zero_copy_only=False)
            found = [], [], [], [], []
            for size, row, piece in windows(batch.column(0), range(1, PIECE + 1)):
                keep = (length[row] == size) | (size == PIECE)
                first, second = spots(piece[keep], size)
                for part, values in zip(found, (row[keep], np.full(keep.sum(), size), piece[keep].view(np.int64), first, second)):
                    part.append(values)
            yield with_pieces(batch, *found)

    return names.mapInArrow(run, with_longs(names, "__size", "__piece", "__spot1", "__spot2"))


def held_pieces(files: DataFrame, own: DataFrame, sizes: list[int]) -> DataFrame:
    """``files`` once for each piece (size, piece) of ``own`` that their name holds: pieces of no name are dropped where they are cut.

    The filter is a Bloom filter of fixed size (at most 2^20 numbers reach the driver); what it lets through too much meets no name later.
    """
    word = own.select(F.explode(F.array("__spot1", "__spot2")).alias("spot")).groupBy(F.shiftright("spot", 6).alias("word"))
    table = word.agg(F.bit_or(F.expr("shiftleft(1L, CAST(spot & 63 AS INT))")).alias("bits")).toArrow()
    filled = np.zeros(FILTER_BITS // 64, np.uint64)
    filled[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    sent = files.sparkSession.sparkContext.broadcast(filled)

    def run(batches):
        bits = sent.value
        hit = lambda spot: (bits[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1) > 0
        for batch in batches:
            found = [], [], []
            for size, row, piece in windows(batch.column(0), sizes):
                first, second = spots(piece, size)
                keep = hit(first)
                keep[keep] = hit(second[keep])
                row, piece = row[keep], piece[keep].view(np.int64)
                order = np.lexsort((piece, row))
                row, piece = row[order], piece[order]
                new = np.r_[True, (row[1:] != row[:-1]) | (piece[1:] != piece[:-1])][: len(row)]  # once for a file
                for part, values in zip(found, (row[new], np.full(new.sum(), size), piece[new])):
                    part.append(values)
            yield with_pieces(batch, *found)

    return files.mapInArrow(run, with_longs(files, "__size", "__piece"))


def containing(names: DataFrame, files: DataFrame, name: str, filename: str, order: str, value: str) -> DataFrame:
    """(name, value) of the file with the smallest ``order`` whose name contains the (distinct) name; names in no file are absent.

    File names are cut into pieces of at most ``PIECE`` bytes, of lengths that names have, and only pieces that a name has leave the
    task. A name of at most that length is a piece, so its first file comes from a map-side aggregate over pieces and no pair is formed,
    even if every file has it. A longer name has all its pieces in every file that contains it, so it is compared only with the files
    that share its rarest one; a name with a piece that no file has needs none. The empty name is in every file.
    """
    names = names.select(name).where(F.col(name).isNotNull())
    files = files.where(F.col(filename).isNotNull() & F.col(order).isNotNull()).select(F.col(filename).alias("__file"), F.col(order).alias("__order"), F.col(value).alias("__value"))
    first = F.min_by("__value", "__order").alias(value)
    own = written(own_pieces(names, name))
    held = [r[0] for r in own.select("__size").distinct().collect()]  # at most PIECE numbers
    everywhere = None if (empty := names.where(F.length(name) == 0)).isEmpty() else empty.crossJoin(files.agg(first).where(F.col(value).isNotNull()))
    if not held:
        return everywhere if everywhere is not None else names.where(F.lit(False)).withColumn(value, F.lit(None).cast(files.schema["__value"].dataType))
    key = ["__size", "__piece"]
    indexed = written(held_pieces(files, own, held))
    per_piece = written(indexed.groupBy(*key).agg(F.count(F.lit(1)).alias("__files"), first))
    short = own.where(F.octet_length(name) <= PIECE).join(per_piece, key).select(name, value)
    pieces = own.where(F.octet_length(name) > PIECE).select(name, *key).join(per_piece.select(*key, "__files"), key, "left")
    rarest = pieces.groupBy(name).agg(F.min_by(F.struct(*key), F.coalesce("__files", F.lit(0))).alias("__rarest")).select(name, "__rarest.*")
    near = rarest.join(indexed, key).where(F.contains("__file", F.col(name)))
    out = short.unionByName(near.groupBy(name).agg(first))
    return out if everywhere is None else out.unionByName(everywhere.select(name, value))


def match_cascade(records: DataFrame, meta: DataFrame, name: str = "record_name", key: str = "meta_id",
                  filename: str = "filename", cols=("age", "sex")) -> DataFrame:
    """Metadata by exact id, else by the number before '_', else by the first (by id) file name holding the name.

    ``key`` is text. Each step sees only the distinct names that the steps before left over; a name without a number skips
    the second. Records meet the names' results once. Those without a name stay, spread by their other columns.
    """
    cols = list(cols)
    records = records.drop(*cols, "matched_by")
    value = F.struct(*cols).alias("__v")
    known = meta.where(F.col(key).isNotNull())
    plain = dedup(known.select(F.col(key).cast("string").alias("__k"), *cols), ["__k"], cols).select("__k", value)
    names = records.select(F.col(name).cast("string").alias("__name")).where("__name IS NOT NULL").distinct()
    step = written(names.join(plain, F.col("__name") == F.col("__k"), "left"))
    found = [step.where("__k IS NOT NULL").select("__name", "__v", F.lit("exact").alias("matched_by"))]
    number = dedup(plain.select(F.col("__k").try_cast("bigint").alias("__num"), "__v").where("__num IS NOT NULL"), ["__num"], ["__v"])
    rest = step.where("__k IS NULL").select("__name", numeric_id("__name").alias("__own"))
    step = written(rest.where("__own IS NOT NULL").join(number, F.col("__own") == F.col("__num"), "left").select("__name", "__num", "__v"))
    found.append(step.where("__num IS NOT NULL").select("__name", "__v", F.lit("numeric").alias("matched_by")))
    if filename in meta.columns:
        pending = written(rest.where("__own IS NULL").select("__name").unionByName(step.where("__num IS NULL").select("__name")))
        files = known.select(F.col(filename).cast("string").alias("__f"), F.struct(F.col(key).cast("string"), *cols).alias("__id"), value)
        found.append(containing(pending, files, "__name", "__f", "__id", "__v").select("__name", "__v", F.lit("filename").alias("matched_by")))
    matched = found[0]
    for more in found[1:]:
        matched = matched.unionByName(more)
    # A record without a name gets a key that no name has.
    spread = F.concat(F.lit("\0"), F.xxhash64(*[F.col(f"`{c}`") for c in records.columns]).cast("string"))
    out = records.withColumn("__of", F.coalesce(F.col(name).cast("string"), spread)).join(matched.withColumnRenamed("__name", "__of"), "__of", "left")
    return out.select(*records.columns, *[F.col("__v")[c].alias(c) for c in cols], "matched_by")


def link_outcomes(ecg: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Records with their diagnoses on study_id, else on subject_id with one row per subject.

    Columns of the left side win over columns of the same name.
    """
    if "study_id" not in ecg.columns and "ecg_id" in ecg.columns:
        ecg = ecg.withColumn("study_id", F.col("ecg_id"))
    if "study_id" in ecg.columns and "study_id" in diagnoses.columns:
        key, right = "study_id", diagnoses
    elif "subject_id" in ecg.columns and "subject_id" in diagnoses.columns:
        key = "subject_id"
        right = dedup(diagnoses, [key], [c for c in diagnoses.columns if c != key])
    else:
        raise ValueError("no common identifier (study_id or subject_id)")
    return ecg.join(right.select(key, *[c for c in right.columns if c != key and c not in ecg.columns]), key, "inner")


def flag_membership(df: DataFrame, sets: dict[str, DataFrame], key: str = "subject_id") -> DataFrame:
    """One boolean column per named id set."""
    for name, ids in sets.items():
        marked = ids.select(key).distinct().withColumn(name, F.lit(True))
        df = df.join(marked, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))
    return df


def unprocessed(df: DataFrame, done: DataFrame, key: str = "ecg_id") -> DataFrame:
    """Rows whose id is not among those already processed."""
    return df.join(done.select(key), key, "left_anti")
