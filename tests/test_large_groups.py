import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from platewise.operators import ordered as O
from platewise.plans import catalog, inputs


def test_sketches_of_part_of_the_rows_only_propose(spark, monkeypatch):
    """A feature that the sketched rows miss, the ends of the ranks and ties: all exact, as every row is counted."""
    monkeypatch.setattr(O, "SKETCH_ROWS", 1000)
    monkeypatch.setattr(O, "SKETCH_SHARE", 0.0)
    rng = np.random.default_rng(5)
    n = 20_000
    pdf = pd.DataFrame({"g": np.where(np.arange(n) < 12_000, "a", "b"), "x": rng.normal(size=n), "tied": np.floor(rng.normal(size=n)), "rare": np.nan})
    pdf.loc[[7, 19, 5000], "rare"] = [3.0, -1.0, 2.0]
    df = spark.createDataFrame(pdf).withColumn("rare", F.when(~F.isnan("rare"), F.col("rare")))
    proposed, plain = [], O._bounded

    def kept(*args):
        proposed.append(plain(*args))
        return proposed[-1]

    monkeypatch.setattr(O, "_bounded", kept)
    probs = [0.0, 0.025, 0.5, 0.975, 1.0]
    got = {r["g"]: r for r in O.group_quantiles(df, ["g"], ["x", "tied", "rare"], probs, task_values=3000).collect()}
    for g, part in pdf.groupby("g"):
        for f in ("x", "tied"):
            np.testing.assert_allclose(got[g][f], np.quantile(part[f], probs), rtol=1e-12)
    np.testing.assert_allclose(got["a"]["rare"], np.quantile([-1.0, 2.0, 3.0], probs), rtol=1e-12)
    assert got["b"]["rare"] == []
    bounds = {(r["g"], r["feature"]): r["bounds"] for r in proposed[0].collect()}
    # The smallest and largest sketched values are no bounds; around the median there are two.
    assert bounds["a", "x"][0]["lo"] is None and bounds["a", "x"][-1]["hi"] is None and ("b", "rare") not in bounds
    assert bounds["a", "x"][2]["lo"] is not None and O._part(20_000) == 0.05 and O._part(500) == O._part(None) == 1.0


def _line_items(spark, sf):
    rows = [
        (i, i, s, i % 7, float(i % 50), i * 1.5, 0.01 * (i % 10), 0.02 * (i % 5), "ANR"[i % 3], "O", dt.datetime(1992 + i % 7, 1, 2))
        for i, s in enumerate([*range(1, 41), -1, -2, -7, None, 3])
    ]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double"
    df = spark.createDataFrame(rows, f"{names}, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")
    df.write.parquet(f"{sf}/lineitem.parquet")
    return df


def test_constant_keys_are_those_of_the_text(spark, tmp_path):
    li = _line_items(spark, tmp_path)
    got = inputs.measure(spark, str(tmp_path)).select("l_orderkey", "Metadata_Biorep", "Tech_replica", "Metadata_Well")
    tech = F.substr(F.lit("BCD"), (F.col("l_linenumber") % 3 + 1).cast("int"), F.lit(1))
    biorep = F.concat(F.lit("BR"), (F.col("l_suppkey") % 4 + 1).cast("string"))
    want = li.select("l_orderkey", biorep, tech, F.concat(tech, (F.col("l_partkey") % 10 + 2).cast("int").cast("string")))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == sorted(map(tuple, want.collect()), key=lambda r: r[0])


@pytest.mark.parametrize("name", ["trimmed", "_wider"])
def test_the_day_step_does_not_repeat_the_row_step(spark, tmp_path, monkeypatch, name):
    """Scores and correlations start from stored rows of the row step; before, the day step read the line items anew each time."""
    _line_items(spark, tmp_path)
    stored, plain = {}, catalog.T.stage

    def kept(df, what):
        stored[what] = plain(df, what)
        return stored[what]

    monkeypatch.setattr(catalog.T, "stage", kept)
    getattr(catalog, name)(spark, str(tmp_path)).collect()
    assert stored["row-standardized"].count() == 45 and not {"cell_ID", "Day_Well_BR"} & set(stored["row-standardized"].columns)
