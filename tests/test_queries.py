"""Every registered query outside the removable subpackage against its SQL, and that the library stands without that subpackage."""

import pathlib
import subprocess
import sys

import duckdb
import pytest

from tidewatch.plans import queries as q
from tidewatch.plans import source_queries, stream_queries  # noqa: F401  register more

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = pathlib.Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def text(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, con, name):
    df = q.QUERIES[name](spark, SF)
    got, columns = df.collect(), sorted(df.columns)
    if name in q.ORACLES:
        want = con.execute(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({q.ORACLES[name]})").fetchall()
        assert sorted(tuple(text(r[c]) for c in columns) for r in got) == sorted(tuple(map(text, r)) for r in want)
    assert got or name in ("q_osv_severity",)


def test_nothing_else_imports_the_subpackage():
    name = ".".join(("tidewatch", "llm"))
    for p in (ROOT / "tidewatch").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p


def test_entry_without_the_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT / "tidewatch", tmp_path / "tidewatch", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert out.stdout.split() == [str(len(q.QUERIES)), str(len(q.ORACLES))], out.stderr
