"""The driver's contract, without the llm subpackage and with it."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as e

ROOT = Path(__file__).resolve().parents[1]


def test_every_oracle_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 80


def test_entry_has_rows(spark):
    assert e.entry(spark).columns == ["pair", "hop", "rank", "nodes", "rels", "cost"]


def test_library_stands_without_llm(tmp_path):
    """Copied without the subpackage, the entry still imports and lists the rest."""
    import shutil

    shutil.copytree(ROOT / "pathloom", tmp_path / "pathloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert not any(n.startswith('op') for n in q); print(len(q), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= 80


@pytest.mark.parametrize("name", ["kg_degree", "metapath_compound", "bm25_topk", "hybrid_match_topk", "beam_prune", "em_per_hop", "answer_extract", "entity_link", "record_pairs"])
def test_against_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = e.queries()[name](spark, sf)
    want = con.execute(e.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(c[0] for c in want.description)
    order = [c[0] for c in want.description]
    shown = lambda v: round(v, 5) if isinstance(v, float) else v
    rows = sorted(repr([shown(dict(zip(order, r, strict=True))[c]) for c in columns]) for r in want.fetchall())
    assert sorted(repr([shown(r[c]) for c in columns]) for r in got.collect()) == rows and rows
