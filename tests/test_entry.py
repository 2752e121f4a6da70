import ast
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from leafmill.plans.queries import ORACLE_SQL, QUERIES

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not there")


def same(df):
    df = df[sorted(df.columns)].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


@needs_data
@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_sql_says_the_same(spark, duck, name):
    got, want = same(QUERIES[name](spark, DATA).toPandas()), same(duck.execute(ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want) and (got == want).all().all()


@needs_data
@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL])
def test_other_queries_run(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns and df.limit(5).collect() is not None


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_training_data_operators():
    """Nothing else imports them; the entry module imports where they and the pipeline are absent."""
    for path in (ROOT / "leafmill").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any(n.startswith("leafmill.llm") or n == "corpus_pipeline" for n in names), path
    code = "import sys; sys.modules['leafmill.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op1') for n in q) and 'pipeline' not in q and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
