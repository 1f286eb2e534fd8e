"""Per-record intervals from a table of beats (fiducial points as sample indexes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096


def with_rr(beats: DataFrame, key: str = "ecg_id", chunk: int = CHUNK) -> DataFrame:
    """Add rr_samples: distance to the next R peak (null on the last beat).

    The window works on chunks of ``chunk`` beats; the first beat of a chunk is copied into the
    one before it, so a very long record still spreads over many tasks. ``beat_no`` is the
    position of the beat in its record.
    """
    part = F.floor(F.col("beat_no") / F.lit(chunk))
    copies = F.when((F.col("beat_no") % chunk == 0) & (F.col("beat_no") > 0), F.array(part, part - 1)).otherwise(F.array(part))
    rows = beats.withColumn("__home", part).withColumn("__part", F.explode(copies))
    ahead = F.lead("r_peak").over(Window.partitionBy(key, "__part").orderBy("beat_no"))
    return (rows.withColumn("rr_samples", ahead - F.col("r_peak"))
            .filter(F.col("__part") == F.col("__home")).drop("__home", "__part"))


def ms(samples, fs: int) -> Column:
    return samples * F.lit(1000.0 / fs)


def strictly(value: Column, lo: float, hi: float) -> Column:
    return F.when((value > lo) & (value < hi), value)


def interval_columns(fs: int = 500) -> dict[str, Column]:
    """Beat-level PR, QRS and QT in ms, null outside their plausible range.

    The last beat has no PR; a missing Q peak starts QT 40 ms (whole samples) before R.
    """
    q_start = F.coalesce(F.col("q_peak"), F.col("r_peak") - int(40 * fs / 1000))
    return {
        "pr_ms": F.when(F.col("rr_samples").isNotNull(),
                        strictly(ms(F.col("r_peak") - F.col("p_onset"), fs), 80, 400)),
        "qrs_ms": strictly(ms(F.col("s_peak") - F.col("q_peak"), fs), 40, 200),
        "qt_ms": strictly(ms(F.col("t_offset") - q_start, fs), 200, 700),
    }


def _median(c) -> Column:
    # Sample distances take few distinct values, so the buffer of a record stays small.
    return F.percentile(c, 0.5)


def rr_from_beats(beats: DataFrame, fs: int = 500, key: str = "ecg_id") -> DataFrame:
    """Median RR and heart rate per record."""
    rows = with_rr(beats, key).withColumn("rr", ms(F.col("rr_samples"), fs))
    out = rows.groupBy(key).agg(_median("rr").alias("rr_ms"))
    return out.withColumn("hr_bpm", F.when(F.col("rr_ms") > 0, 60000.0 / F.col("rr_ms")))


def beat_interval(beats: DataFrame, name: str, fs: int = 500, key: str = "ecg_id") -> DataFrame:
    """Median of one interval ('pr_ms', 'qrs_ms' or 'qt_ms') per record."""
    rows = with_rr(beats, key) if name == "pr_ms" else beats
    return rows.withColumn("v", interval_columns(fs)[name]).groupBy(key).agg(_median("v").alias(name))


def detection_rates(beats: DataFrame, key: str = "ecg_id", min_beats: int = 3) -> DataFrame:
    """Beat count and share of beats with a P and a T wave; records with too few beats drop out."""
    out = beats.groupBy(key).agg(F.count(F.lit(1)).alias("n_beats"), F.count("p_onset").alias("p"),
                                 F.count("t_offset").alias("t"))
    return out.filter(F.col("n_beats") >= min_beats).select(
        key, "n_beats", (F.col("p") / F.col("n_beats")).alias("p_wave_detection_rate"),
        (F.col("t") / F.col("n_beats")).alias("t_wave_detection_rate"))


def sample_at(signal, position) -> Column:
    """Signal value at a 0-based position; null outside the signal."""
    signal = F.col(signal) if isinstance(signal, str) else signal
    at = F.col(position) if isinstance(position, str) else position
    return F.when(at >= 0, F.try_element_at(signal, (at + 1).cast("int"))).cast("double")


def amplitudes(beats: DataFrame, signals: DataFrame, key: str = "ecg_id",
               peaks=(("r_amplitude", "r_peak"), ("p_amplitude", "p_peak"), ("t_amplitude", "t_peak"))) -> DataFrame:
    """Median signal value at the R, P and T peaks per record.

    The long signal arrays meet one array of positions per record, not every beat: positions are
    collected first (they are fewer than the samples they point into).
    """
    present = [(a, p) for a, p in peaks if p in beats.columns]
    positions = beats.groupBy(key).agg(*[F.collect_list(p).alias(p) for _, p in present])
    joined = positions.join(signals, key)
    out = []
    for name, peak in present:
        values = F.array_compact(F.transform(F.col(peak), lambda at: sample_at("signal", at)))
        out.append(array_median(values).alias(name))
    return joined.select(key, *out)


def array_median(values: Column) -> Column:
    """Median of an array of doubles, null if empty."""
    ordered, n = F.sort_array(values), F.size(values)
    low = F.try_element_at(ordered, F.floor((n + 1) / 2).cast("int"))
    high = F.try_element_at(ordered, F.floor(n / 2).cast("int") + 1)
    return F.when(n > 0, (low + high) / 2.0)


def record_features(beats: DataFrame, signals: DataFrame | None = None, fs: int = 500, key: str = "ecg_id",
                    min_beats: int = 3) -> DataFrame:
    """All intervals, rates and (with signals) amplitudes per record in one aggregation."""
    rows = with_rr(beats, key).withColumns({"rr": ms(F.col("rr_samples"), fs), **interval_columns(fs)})
    out = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_beats"), _median("rr").alias("rr_ms"), _median("pr_ms").alias("pr_ms"),
        _median("qrs_ms").alias("qrs_ms"), _median("qt_ms").alias("qt_ms"),
        (F.count("p_onset") / F.count(F.lit(1))).alias("p_wave_detection_rate"),
        (F.count("t_offset") / F.count(F.lit(1))).alias("t_wave_detection_rate"),
    ).filter(F.col("n_beats") >= min_beats).withColumns({
        "rr_s": F.col("rr_ms") / 1000.0,
        "hr_bpm": F.when(F.col("rr_ms") > 0, 60000.0 / F.col("rr_ms"))})
    return out if signals is None else out.join(amplitudes(beats, signals, key), key, "left")


def alt_intervals(beats: DataFrame, fs: int = 500, key: str = "ecg_id") -> DataFrame:
    """Second pairing: Q with T of the same beat (200-600 ms), RR kept within 0.4-2.0 s."""
    rows = with_rr(beats, key).withColumns({
        "rr": strictly(F.col("rr_samples") / F.lit(float(fs)), 0.4, 2.0),
        "qt": strictly(ms(F.col("t_offset") - F.col("q_peak"), fs), 200, 600)})
    out = rows.groupBy(key).agg(_median("qt").alias("qt_ms"), _median("rr").alias("rr_s"),
                                F.count(F.lit(1)).alias("n_beats"))
    return (out.filter(F.col("qt_ms").isNotNull() & F.col("rr_s").isNotNull())
            .withColumn("hr_bpm", 60.0 / F.col("rr_s")))


def is_usable(usable="usable", n_beats="n_beats", hr="hr_bpm") -> Column:
    """Usable, with beats and a known non-zero heart rate."""
    return F.coalesce(F.col(usable) & (F.col(n_beats) > 0) & (F.col(hr) != 0), F.lit(False))
