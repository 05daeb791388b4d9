import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from sieveline.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str([cell(x) for x in v]) if isinstance(v, (list, tuple)) else v if isinstance(v, str) else repr(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_against_its_sql(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    rows = sorted([cell(r[c]) for c in columns] for r in got.collect())
    if name not in registry.ORACLES:
        assert rows
        return
    found = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert rows == sorted([cell(r[names.index(c)]) for c in columns] for r in found.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_library_does_not_import_the_training_data_package():
    root = Path(entry.__file__).parent / "sieveline"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", path.read_text(), re.M), path
