"""Queries against their SQL on the smallest tables."""

import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from tallyspark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One of each kind; the driver compares all of them.
CHOSEN = ["win5_largest_remainder", "jn1_jn2_invoice_payment", "agg3_invoice_outcomes", "cls_revenue_states", "win8_waterfall", "crt_critic_gate", "jn10_blocking", "win4_versions", "prj4_invoice_payloads", "str_g_close_repeats", "jn3_payment_bank", "snk3_reconciliation_artifact", "a13_name_groups", "src9_document_intake"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", CHOSEN)
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)

    def cell(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return ""
        return f"{v:.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)[:10] if hasattr(v, "year") else str(v)

    rows = lambda df: sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_identity_scores_all_blocked_pairs(spark):
    assert registry.QUERIES["idn9_match_critic"](spark, SF).count() == registry.QUERIES["jn10_blocking"](spark, SF).count()
