"""Every registered query with SQL against DuckDB, and the known answers of the fixtures."""

import duckdb
import pandas as pd
import pytest

from cohortlens import catalogue
from cohortlens.sources.tables import BASE


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cells(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return "null"
        return f"{float(x) + 0.0:.5f}" if isinstance(x, (int, float)) and not isinstance(x, bool) or hasattr(x, "dtype") and x.dtype.kind in "iuf" else str(x)

    return sorted(tuple(cell(x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, duck, name):
    got = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)


#: Held to plain Python in test_plain_versions.py, or to known answers in test_fixtures.py.
ELSEWHERE = "a06_agreement_ci a06_bootstrap_ci e04_cross_channel_cluster_exact e07_conduction_class e09_coupling_relation j05_difflib_candidates j15_asof_claimed m01_balanced_softmax_fit p01_fold_unicode p06_clinical_text_windows t02_evaluate_before_learn_stream".split()


def test_every_query_is_held_to_something(spark, sf_dir):
    assert sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)) == sorted(ELSEWHERE)
    for name in ("a06_bootstrap_ci", "j05_difflib_candidates"):
        assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
