"""Groups of three rows stay in the reports and are marked, not dropped."""

import pytest
from pyspark.sql import functions as F

from isoqt.plans import extremes, strata


@pytest.fixture(scope="module")
def small(ecg):
    """The rows of one zone cut to three; every report below must still name it."""
    slow = ecg.filter("hr_bpm BETWEEN 70 AND 80 AND qtc_bazett IS NOT NULL").orderBy("ecg_id").limit(3).withColumn("hr_bpm", F.lit(45.0))
    return slow.unionByName(ecg.filter(F.col("hr_bpm") >= 50))


def marked(df, label, n="n"):
    row = df.filter(label).select(n, "enough").first()
    assert row is not None and row[n] <= 3 and row["enough"] is False


def test_small_groups_are_marked(small):
    marked(strata.stratified_metrics(small, ["bazett"]), "kind = 'hr' AND n BETWEEN 1 AND 3")
    marked(strata.hr_scenarios(small), "scenario = 'bradycardia_hr_below_50'")
    marked(strata.extreme_cases(small, 50, 120), "label = 'HR_below_50'")
    marked(strata.stratum_profile(small, ["bazett"]), "n_rows <= 3", "n_rows")
    marked(strata.stratum_concordance(small), "n <= 3")
    big = strata.hr_scenarios(small).filter("scenario = 'resting_hr_60_80'").first()
    assert big["enough"] is True


def test_small_triage_zone_is_marked(small):
    norm = small.withColumns({"superclass": F.lit("NORM"), "hr_zone": F.when(F.col("hr_bpm") < 50, "slow").otherwise("other"),
                              "threshold": F.lit(450.0), "sex_group": F.lit("male")})
    marked(extremes.nns(norm), "zone = 'slow'")
