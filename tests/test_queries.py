"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from callgrove import catalog

DIR = "/root/testdata/sf0.001"
#: The others are compared by the correctness run on larger tables.
NAMES = ["src1_vcf_scan", "snk4_keyed_result_store", "prj16_allele_swap_to_ref", "flt5_allele_balance_mask", "flt9_hwe_filter", "jon8_exclude_ranges", "jon12_sample_pairs", "agg5_heterozygosity_f", "agg12_threshold_sweep_dp", "agg22_mann_whitney_u", "rsh2_state_pivot", "cnc3_summary", "cnc7_allele_confusion", "win1_pareto_front", "lin6_ibd_pi_hat", "pip2_sample_qc"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")


def shaped(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = [("" if pd.isna(v) else repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)) for v in df[c].tolist()]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("supplier", "part", "lineitem", "documents", "benchmark", "pages"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    a, b = shaped(catalog.queries()[name](spark, DIR).toPandas()), shaped(duck.execute(catalog.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(a, b)


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert len(catalog.queries()) > 150


@pytest.mark.parametrize("name", ["win5_sort", "win5_sort_all"])
def test_sort(spark, duck, name):
    test_query(spark, duck, name)


def test_counts_without_a_call_are_zero(spark, tmp_path):
    """Variants whose cases, or whose samples at all, have no genotype: counts are 0 and no frequency is taken for none."""
    import pyarrow.parquet as pq

    line = pq.read_table(f"{DIR}/lineitem.parquet").to_pandas()
    case = pq.read_table(f"{DIR}/supplier.parquet").to_pandas().query("s_nationkey < 8")["s_suppkey"]
    line["l_linenumber"] = line["l_linenumber"].where((line["l_partkey"] % 5 != 0) | ~line["l_suppkey"].isin(case), 7).where(line["l_partkey"] % 7 != 0, 7)
    line.to_parquet(tmp_path / "lineitem.parquet")
    own = duckdb.connect()
    for name in ("supplier", "part"):
        pq.write_table(pq.read_table(f"{DIR}/{name}.parquet"), tmp_path / f"{name}.parquet")
    for name in ("supplier", "part", "lineitem"):
        own.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    got, want = catalog.queries()["pip12_frequency_split"](spark, str(tmp_path)).toPandas(), own.execute(catalog.oracle_sql()["pip12_frequency_split"]).df()
    assert (got[["hom_ref", "het", "hom_alt"]].sum(axis=1) == 0).any()
    pd.testing.assert_frame_equal(shaped(got), shaped(want))
