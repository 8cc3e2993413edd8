import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from platewise.plans import inputs as X
from platewise.plans.profile import selected_profiles
from platewise.operators.standardize import standardize_row_day
from platewise.session import shared_dir, stage
from tests.oracle_harness import compare, connect

SF = "/root/testdata/sf0.001"
QUICK = (
    "pool_wells", "trim_wells", "emd_event_types", "group_stats", "kruskal_events", "stratum_counts", "sample_equal",
    "filter_report", "unplaced_features", "split_manifest", "image_ranges", "link_chain", "link_via", "exclude_site",
    "normalize_keys", "mmd", "mahalanobis", "density", "combine_instances",
)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_query_agrees_with_sql(spark, con, name):
    ok, why = compare(spark, con, SF, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, why


def test_entry_has_scores(spark):
    df = entry.entry(spark)
    assert df.columns[-1] == "EMD_score" and df.count() > 0


def test_selection_chain(spark):
    std = standardize_row_day(X.profiles(spark, SF), X.ROLES)
    q, dose = F.col("rp_norm_l_quantity"), F.lit(11) - F.col("Concentration")
    std = std.withColumns({"rp_norm_up": q + dose * 9, "rp_norm_up_too": q + dose * 9.1})
    std = stage(std.drop("rp_norm_l_quantity", "rp_norm_l_extendedprice"), "chain")
    responding, kept, table = selected_profiles(std, X.ROLES, X.ROLES.days)
    assert {"rp_norm_up", "rp_norm_up_too"} <= set(responding)
    assert "rp_norm_up" in kept and "rp_norm_up_too" not in kept
    assert [c for c in table.columns if c.startswith("rp_norm")] == [c for c in std.columns if c in kept]
    assert table.count() == std.count()


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == (configured or spark.sparkContext.getCheckpointDir()).rstrip("/")
