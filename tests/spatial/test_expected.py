"""Every query that has an SQL statement, against it in DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__
from terrace.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def rows(frame):
    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return v if isinstance(v, str) else round(float(v), 6) + 0.0

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(value, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.EXPECTED))
def test_query_equals_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.EXPECTED[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_registry():
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
    assert set(queries.EXPECTED) <= set(queries.QUERIES)


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    """The registry, with that subpackage and the pipeline taken away."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "terrace", tmp_path / "terrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; assert 'a1_scatter' in e.queries() and not any(k.startswith('op') for k in e.queries()) and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True).returncode == 0
