"""Every query against its SQL, on the smallest tables; and what the driver relies on."""

import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from loreweave import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parents[1]


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v if v is None or isinstance(v, (int, str, bytes)) else float(v) if type(v).__name__ == "Decimal" else str(v)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_agrees_with_its_sql(spark, duck, small, name):
    df = catalog.queries()[name](spark, small)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    res = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = [tuple(plain(r[i]) for i in at) for r in res.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_has_rows(spark, small, name):
    assert catalog.queries()[name](spark, small).count() > 0


def test_entry_without_the_corpus_operators(tmp_path):
    """The rest imports and answers where that subpackage and the pipeline are gone."""
    import shutil

    shutil.copytree(ROOT / "loreweave", tmp_path / "loreweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(catalog.queries())), str(len(catalog.oracle_sql())), "False"], out.stderr


def test_nothing_else_imports_the_corpus_operators():
    for p in (ROOT / "loreweave").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
