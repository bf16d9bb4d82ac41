"""What a review found on larger tables: SQL with constants of small data, ties left to rounding, draws and fits beyond a block."""

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from hazardspark import queries
from hazardspark.llm import common
from hazardspark.operators import panel, resample, riskset
from hazardspark.plans import cox, replicates
from hazardspark.sources import panels
from tests.test_oracle import rows


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """1,100 subjects of which 1,050 buy on the fifth day, with totals of doses that are one step apart."""
    ev = [(i, pd.Timestamp(2024, 1, 5), "purchase", 200.0) for i in range(1050)] + [(i, pd.Timestamp(2024, 1, 2 + i % 3), "click", 1623.4 + i // 2 % 50 / 10) for i in range(1100)]
    ev += [(i, pd.Timestamp(2024, 1, 9), "purchase", 160.0) for i in range(1050, 1060)]
    folder = tmp_path_factory.mktemp("crowded")
    pd.DataFrame(ev, columns=["user_id", "ts", "event_type", "value"]).astype({"ts": "datetime64[us]"}).to_parquet(folder / "events.parquet")
    return str(folder)


def both(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return rows(queries.QUERIES[name](spark, folder).toPandas()), rows(con.sql(queries.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", ["baseline_cumhaz", "martingale_efron", "martingale_breslow"])
def test_hazards_of_more_than_a_thousand_ties(spark, crowded, name):
    got, want = both(spark, crowded, name)
    assert got == want


def test_times_one_step_apart_stay_apart(spark, crowded):
    df = spark.createDataFrame([(x,) for x in (16.234, 16.235, 16.2354)], "t double")
    assert sorted(r.t for r in panel.merge_times(df, "t", 3).collect()) == [16.234, 16.235, 16.235]
    got, want = both(spark, crowded, "tie_repair")
    assert got == want and len({m for _, m in got}) == 50


@pytest.fixture(scope="module")
def twice(spark):
    """More rows than a block of draws."""
    days = panels.person_days(spark, "/root/testdata/sf0.01")
    return days.union(days.withColumn("id", F.col("id") + 1000)).persist()


def test_tables_of_several_blocks_have_the_hash_s_draws(spark, twice):
    n = twice.count()
    assert n > resample.DRAW_BLOCK
    found = resample.weighted_bootstrap(twice, 70, 1, ["id", "stop"], ["id", "stop"], block=1000)
    got = {}
    for r in found.withColumnRenamed("__slice", "s").collect():
        got |= {(r.id, r.stop, r.s * resample.SLICE + k): w for k, w in enumerate(r.w) if w}
    keys = sorted((r.id, r.stop) for r in twice.select("id", "stop").collect())
    for b in (0, 1, 63, 64, 69):
        w = resample.draws_of(n, b)
        assert {k: int(x) for k, x in zip(keys, w) if x} == {(i, t): x for (i, t, c), x in got.items() if c == b}


def test_replicates_beyond_a_task_are_the_task_s(twice):
    for unit in ("row", "subject"):
        a, b = (replicates.bootstrap_fits(twice, ["sex", "age"], 3, unit=unit, task_values=v).toPandas().sort_values(["b", "term"]) for v in (10**7, 0))
        assert np.allclose(a[["coef", "se", "loglik"]], b[["coef", "se", "loglik"]], atol=1e-7)
    a, b = (cox.cox_bootstrap("Surv(start, stop, event) ~ sex", twice, 3, risk_set="interval", all_results=True, task_values=v).fits.toPandas().sort_values("b") for v in (10**7, 0))
    assert np.allclose(a[["coef", "se", "loglik"]], b[["coef", "se", "loglik"]], atol=1e-7)


def test_permutations_are_weights_and_not_copies(spark, monkeypatch):
    seen, real = [], replicates.vector_fits
    monkeypatch.setattr(replicates, "vector_fits", lambda rows, *a, **k: seen.append(rows.count()) or real(rows, *a, **k))
    panel_rows = queries._channel_features(spark, "/root/testdata/sf0.01")[0]
    assert replicates.permuted_fits(panel_rows, "channel", queries.SPLINES, 19).count() == 4 * 20 * 3
    assert len(seen) == 1 and seen[0] < 4 * panel_rows.count()


def test_many_ties_are_no_rows():
    a, dead, deaths = np.array([5.0, 2.0, 0.0]), np.array([3.0, 7.0, 4.0]), np.array([1.0, 4.0, 300_000.0])
    got = riskset.tie_sums(a, dead, deaths, "efron")
    for i in range(3):
        c = np.arange(1, int(deaths[i]) + 1) / deaths[i]
        s = a[i] + c * dead[i]
        assert np.allclose(got[i], [(1 / s).sum(), (c / s).sum(), (1 / s**2).sum(), (c / s**2).sum(), (c**2 / s**2).sum(), np.log(s).sum()])


def test_long_rows_are_written_a_few_at_a_time(spark):
    rows = spark.range(0, 12, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([b.column(0), pa.array([np.random.default_rng(i).bytes(4 << 20) for i in b.column(0).to_pylist()], pa.binary())], ["id", "x"]) for b in batches), "id long, x binary")
    groups = []
    for options in ({}, common.LONG_ROWS):
        files = [f.removeprefix("file://") for f in common.materialize(rows, **options).inputFiles()]
        groups.append(sum(pq.ParquetFile(f).num_row_groups for f in files))
    assert groups[0] == 1 and groups[1] >= 3
