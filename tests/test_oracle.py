"""Every query with SQL gives the same rows in Spark and in DuckDB; the others run and give rows."""

import pytest

from tests.compare import differences, duck
from tideline import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, con, name):
    assert differences(spark, con, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF) == ""


#: Queries over texts, whose patterns meet letters of all kinds only in the larger tables.
TEXTS = sorted(n for n in catalog.ORACLE_SQL if catalog.QUERIES[n].__module__.rsplit(".", 1)[1] in ("documents", "dialogue", "rules", "turns", "structure"))


@pytest.mark.parametrize("name", TEXTS)
def test_same_rows_of_more_texts(spark, name):
    sf = "/root/testdata/sf0.01"
    assert differences(spark, duck(sf), catalog.QUERIES[name], catalog.ORACLE_SQL[name], sf) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_import_needs_no_session():
    import subprocess
    import sys

    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
