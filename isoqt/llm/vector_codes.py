"""Vector codes: parts of integer vectors, each coded by the nearest entry of its codebook, found by slices of bitmasks.

The components of a vector are ``floor(scale * x)``, cut into ``parts`` equal parts; every part position has a codebook
of at most 64 entries. An entry is one bit of a 64 bit word. For each dimension of a part the entries' coordinates are
sorted, and prefix ``i`` of that order carries the mask of its first ``i`` entries. A query of radius r cuts a slice out
of every dimension (two binary searches, the exclusive or of two prefix masks) and the AND of the slices is the set of
entries in the box of that radius. No entry outside the box is nearer than r, so a best candidate within r is the
nearest entry; else the radius becomes the distance of the best candidate, or doubles where the box was empty.

Each round is one distributed pass: tasks return sums and counts of (part, entry), at most ``parts * 64`` rows each,
Spark adds them, and the new codebooks (again at most that many rows) travel with the next pass.

Defined cases: rows with a null vector or a null, NaN or infinite component are dropped, and so are rows whose length is
not the most frequent one that ``parts`` divides (ties: the longer). A null id sorts last among the first entries, equal
ids by vector; fewer rows than entries make smaller codebooks. Ties of distance go to the lower entry. Components beyond
2^27 (of 64 dimensions; a little less for more) saturate there, so that errors fit 64 bits. Null labels are one group.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoqt.llm.common import written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Copies of the label sums, so that rows of one label meet them in as many tasks.
SALTS = 32


class Slices:
    """Nearest-entry search in one codebook by ANDed slices of prefix masks."""

    def __init__(self, entries: np.ndarray):
        if len(entries) > 64:
            raise ValueError("an entry is a bit of 64: at most 64 entries")
        self.entries = entries
        order = np.argsort(entries, axis=0, kind="stable")
        bits = np.uint64(1) << order.astype(np.uint64)
        self.at = [np.ascontiguousarray(entries[order[:, d], d]) for d in range(entries.shape[1])]
        self.masks = [np.r_[np.zeros(1, np.uint64), np.bitwise_or.accumulate(bits[:, d])] for d in range(entries.shape[1])]
        # A usual distance between neighbours: small boxes that are seldom empty.
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        apart = np.where(apart > 0, apart, np.iinfo(np.int64).max).min(axis=1)
        self.radius = max(1, int(np.sqrt(float(np.median(apart)))) if apart.min() < np.iinfo(np.int64).max else 1)

    def box(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries that differ from ``x`` by at most ``radius`` in every dimension."""
        mask = np.full(len(x), np.iinfo(np.uint64).max, np.uint64)
        for d, (at, prefix) in enumerate(zip(self.at, self.masks)):
            mask &= prefix[np.searchsorted(at, x[:, d] + radius, "right")] ^ prefix[np.searchsorted(at, x[:, d] - radius, "left")]
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every row of ``x``."""
        entry, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        todo, radius = np.arange(len(x)), np.full(len(x), self.radius, np.int64)
        while len(todo):
            mask = self.box(x[todo], radius)
            row, bit = np.nonzero(np.unpackbits(mask[:, None].view(np.uint8), axis=1, bitorder="little"))
            apart = ((x[todo[row]] - self.entries[bit]) ** 2).sum(axis=1)
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
            low = np.minimum.reduceat(apart, first) if len(row) else apart
            held = row[first]
            # Bits ascend within a row, so the first at the least distance is the lower entry.
            hit = np.flatnonzero(apart == np.repeat(low, np.diff(np.r_[first, len(row)])))
            hit = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]] if len(hit) else hit
            entry[todo[held]], error[todo[held]] = bit[hit], low
            near = low <= radius[held] ** 2
            radius = radius * 2
            radius[held] = np.ceil(np.sqrt(low.astype(np.float64))).astype(np.int64) + 1
            open_rows = np.ones(len(todo), bool)
            open_rows[held[near]] = False
            todo, radius = todo[open_rows], radius[open_rows]
        return entry, error


def whole(vectors: DataFrame, column: str, parts: int) -> tuple[DataFrame, int]:
    """(rows with a usable vector, its length)."""
    v = F.col(column)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(v.isNotNull() & sound & (F.size(v) > 0) & (F.size(v) % parts == 0))
    most = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size(v) == (most["n"] if most else 0)), most["n"] if most else 0


def components(values, scale: int, length: int) -> np.ndarray:
    """Integer components (rows, length) of an Arrow list column or of lists."""
    flat = values.flatten().to_numpy(zero_copy_only=False) if isinstance(values, (pa.ListArray, pa.LargeListArray)) else np.asarray(values, np.float64).reshape(-1)
    most = float(1 << ((62 - (length - 1).bit_length()) // 2 - 1))
    return np.clip(np.floor(flat.astype(np.float64) * scale), -most, most).astype(np.int64).reshape(-1, length)


def codebooks(rows: DataFrame, column: str, length: int, parts: int, entries: int, rounds: int, scale: int, id_column: str) -> list[np.ndarray]:
    """The codebook of every part position after ``rounds`` rounds."""
    head = rows.select(id_column, column).orderBy(F.col(id_column).asc_nulls_last(), column).limit(entries).collect()  # `entries` rows
    books = np.split(components([r[1] for r in head], scale, length), parts, axis=1)
    width = length // parts
    for _ in range(rounds):
        slices = [Slices(b) for b in books]

        def sums(batches, slices=slices):
            total = np.zeros((parts, len(slices[0].entries), width + 1), np.int64)
            for batch in batches:
                x = components(batch.column(0), scale, length)
                for p, s in enumerate(slices):
                    part = x[:, p * width : (p + 1) * width]
                    entry = s.nearest(part)[0]
                    np.add.at(total[p], entry, np.c_[part, np.ones(len(part), np.int64)])
            p, e = np.nonzero(total[:, :, width])
            held = total[p, e]
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(held.tolist(), pa.list_(pa.int64()))], names=["part", "entry", "sums"])

        found = rows.select(column).mapInArrow(sums, "part int, entry int, sums array<bigint>").groupBy("part", "entry").agg(
            *[F.sum(F.get("sums", F.lit(i)).cast("decimal(20,0)")).alias(f"s{i}") for i in range(width + 1)])
        books = [b.copy() for b in books]
        for r in found.collect():  # at most parts * entries rows
            books[r["part"]][r["entry"]] = [int(r[f"s{i}"]) // int(r[f"s{width}"]) for i in range(width)]
    return books


def encode(vectors: DataFrame, column: str = "embedding", id_column: str = "vec_id", label: str = "label", parts: int = PARTS, entries: int = ENTRIES,
           rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Vec_id, code, error, label_error, codebooks_sha256 of every usable row."""
    rows, length = whole(vectors.select(F.col(id_column).alias("vec_id"), F.col(column).alias("embedding"), F.col(label).alias("label")), "embedding", parts)
    books = codebooks(rows, "embedding", length, parts, entries, rounds, scale, "vec_id") if length else []
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1)).encode()).hexdigest()
    slices, width = [Slices(b) for b in books], length // parts

    def code(batches):
        for batch in batches:
            x = components(batch.column("embedding"), scale, length)
            found = [s.nearest(x[:, p * width : (p + 1) * width]) for p, s in enumerate(slices)]
            codes = np.stack([entry for entry, _ in found], axis=1).astype(np.uint8)
            errors = sum(error for _, error in found)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(errors, pa.int64())],
                                             names=["vec_id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    coded = written(rows.mapInArrow(code, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"))
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(
        F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return (salted.join(totals, salted["label"].eqNullSafe(totals["of"]) & (salted["salt"] == totals["part"]))
            .select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")))
