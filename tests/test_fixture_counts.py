"""The loan-shaped fixture reproduces the per-slice counts published in FIXTURES.md:
(rows, positives, f0 non-null, f2 non-null, class_raw non-null, work_year non-null, OFFSHORE)."""
import pytest
from pyspark.sql import functions as F

from riskloom.sources.fixtures import app_view

EXPECTED = {
    "/root/testdata/sf0.001": {0: (500, 172, 428, 397, 454, 468, 0),
                               1: (500, 169, 428, 398, 455, 476, 18),
                               2: (500, 152, 429, 397, 454, 464, 0)},
    "/root/testdata/sf0.01": {0: (5000, 1626, 4285, 3997, 4545, 4654, 0),
                              1: (5000, 1662, 4286, 3998, 4546, 4631, 215),
                              2: (5000, 1645, 4286, 3997, 4545, 4629, 0)},
}


@pytest.mark.parametrize("sf_dir", sorted(EXPECTED))
def test_fixture_counts(spark, sf_dir):
    app = app_view(spark, sf_dir)
    rows = app.groupBy("slice").agg(
        F.count(F.lit(1)), F.sum("is_default"), F.count("f0"), F.count("f2"), F.count("class_raw"),
        F.count("work_year"), F.sum(F.when(F.col("industry") == "OFFSHORE", 1).otherwise(0))).collect()
    got = {r[0]: tuple(int(x) for x in r[1:]) for r in rows}
    assert got == EXPECTED[sf_dir]
