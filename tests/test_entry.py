from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
REPO = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "chunk_id", "score", "rank"] and df.count() > 0


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def value(v):
    return None if v is None else f"{v:.6g}" if isinstance(v, float) else str(float(v)) if type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", ["text_clean_cells", "text_headers_footers", "parse_dates", "table_markdown", "table_compare", "vector_search", "bm25_search", "query_analysis", "metrics_retrieval", "catalog_delete"])
def test_oracles_agree(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(value(v) for v in r) for r in rel.fetchall()), key=str)
    assert sorted((tuple(value(v) for v in r) for r in df.select(*names).collect()), key=str) == want


def test_imports_without_the_optional_package(tmp_path):
    """As it is when the training-data operators are taken out."""
    import shutil

    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql(); print('fine')"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, check=False)
    assert out.stdout.strip() == "fine", out.stderr
