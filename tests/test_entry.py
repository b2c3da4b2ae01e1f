"""The registry, and a choice of its queries against their SQL on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def lines(rows):
    text = lambda v: "-" if v is None or v != v else f"{v:.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(text, r)) for r in rows)


# not p2_found: on this folder DuckDB 2.0 answers isnan(NaN) with false, misled by the statistics of the file
CHOICE = ["p6_found", "p6_periods", "p7_found", "p7_grid", "q_asof_causal", "q_interp_clamped", "q_error_summary", "q_merge_order", "q_rolling_mad_gate", "q_unwrap", "q_iir_exp", "q_bias_kalman", "q_node_bins", "q_variant_compare", "q_sign_permutation",
          "p3_stated", "s_late_periods", "s_low_pass", "q_delay_scan", "q_confidence", "q_hold_decay", "q_position_errors", "q_alignment_filtered", "q_gyro_velocity", "q_smooth_export", "q_field_errors", "q_origin", "q_geo_round_trip"]


@needs_data
@pytest.mark.parametrize("name", CHOICE)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    sql = entry.oracle_sql()[name]
    want = duck.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({sql})").fetchall()
    assert lines(df.select(*columns).collect()) == lines(want)


@needs_data
def test_all_sql_is_read_by_the_oracle(duck):
    for name, sql in entry.oracle_sql().items():
        duck.execute(f"EXPLAIN {sql}")


@needs_data
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
