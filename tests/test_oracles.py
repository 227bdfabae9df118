"""Every query with SQL gives the same rows in DuckDB; without the training-data subpackage the others remain."""

import os
import subprocess
import sys

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
import __spark_entry__ as entry  # noqa: E402

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{SF}/{f}'")
    return c


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(columns, want.fetchall())


def test_rest_works_without_the_subpackage(tmp_path):
    code = "import sys; sys.modules['typoforge.llm'] = None\nimport __spark_entry__ as e; q = e.queries(); assert 'solve' in q and not [n for n in q if n.startswith('op')]"
    os.symlink(f"{ROOT}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    (tmp_path / "typoforge").mkdir()
    for f in os.listdir(f"{ROOT}/typoforge"):
        if f != "llm":
            os.symlink(f"{ROOT}/typoforge/{f}", tmp_path / "typoforge" / f)
    code = code.split("\n", 1)[1]
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_entry(spark):
    assert entry.entry(spark).count() > 0
