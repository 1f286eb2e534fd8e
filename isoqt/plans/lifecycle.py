"""The three end-to-end runs: preparing a dataset, the manuscript tables, judging candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame

from isoqt.functions.formulas import all_qtc
from isoqt.operators.beats import record_features
from isoqt.operators.joins import merge_features
from isoqt.operators.moments import hr_corr
from isoqt.operators.reference import poly_reference
from isoqt.operators.schema import drop_incomplete, project_existing, quality_filter, quality_funnel
from isoqt.plans import candidates, manuscript
from isoqt.session import written


def prepare_dataset(beats: DataFrame, features: DataFrame, signals: DataFrame | None = None, by=("dataset",), quality=("signal_quality",),
                    fs: int = 500) -> tuple[DataFrame, DataFrame]:
    """Beats and record features to the prepared table, and the counts of the quality filter.

    Intervals per record, demographic and label columns by id, corrections, quality filter,
    quadratic reference per dataset, wanted columns, complete rows. The intervals are written once,
    since the funnel, the fit and the result all scan them.
    """
    waves = record_features(beats, signals, fs)
    merged = merge_features(waves, features, extra=(*quality, *by))
    merged = written(all_qtc(merged, formulas=("bazett", "fridericia", "framingham", "hodges")))
    kept = poly_reference(quality_filter(merged), 2, "rr1", by)
    return drop_incomplete(project_existing(kept)), quality_funnel(merged)


def manuscript_tables(df: DataFrame, replicates: int = 0) -> dict[str, DataFrame]:
    """Every manuscript table over one prepared copy, partitioned by dataset."""
    rows = written(manuscript.prepare(df), ["dataset"])
    table4, table8 = manuscript.table4(rows), manuscript.table8(rows)
    return {"table2": manuscript.table2(rows, replicates=replicates), "table3": manuscript.table3(rows), "table4": table4, "table6": manuscript.table6(rows),
            "table8": table8, "table8_weighted": manuscript.table8_weighted(table8), "per_dataset": manuscript.per_dataset(rows),
            "headline": manuscript.headline(rows)}


def validate_catalog(df: DataFrame, found: DataFrame, top: int | None = None, n: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Catalog rows to (metrics per dataset, cross-dataset summary, rankings)."""
    catalog = candidates.FormulaCatalog.from_df(found, top)
    rows = catalog.apply(df)
    if "qtc_reference_ms" in rows.columns:
        metrics = candidates.evaluate_formulas(rows, catalog.names)
    else:
        metrics = hr_corr(rows, catalog.names, ["dataset"])
    summary = candidates.cross_dataset_summary(metrics)
    return metrics, summary, candidates.rank_formulas(summary, n)
