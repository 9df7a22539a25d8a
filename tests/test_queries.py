"""Every query runs; those with SQL give what DuckDB gives on the same tables."""

import glob
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tessella.plans import catalog

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]

pytestmark = pytest.mark.skipif(not glob.glob(f"{FOLDER}/*.parquet"), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        found.sql(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return found


def rounded(rows):
    return sorted(str(tuple(round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else None if v is None else str(v) for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    found = catalog.queries()[name](spark, FOLDER)
    if name not in catalog.oracle_sql():
        assert found.count() > 0
        return
    wanted = duck.sql(catalog.oracle_sql()[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    columns = ", ".join(wanted.columns)
    assert rounded(map(tuple, found.select(*wanted.columns).collect())) == rounded(duck.sql(f"SELECT {columns} FROM ({catalog.oracle_sql()[name]})").fetchall())


def test_entry_without_the_subpackage(tmp_path):
    """The entry still imports where the training-data subpackage is not there."""
    for name in ("__spark_entry__.py", "tessella"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "tessella" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and 'records_dashboard' in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
