"""Every query with an SQL twin gives what DuckDB gives."""

from __future__ import annotations

import duckdb
import pytest

from tarnmill import catalog, catalog_records  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def twin():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda x: x.tolist() if hasattr(x, "tolist") else x
    cell = lambda x: None if x is None or x != x else round(x, 6) if isinstance(x, float) else str(x)
    return list(frame.columns), sorted((tuple(cell(plain(x)) for x in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_and_its_twin(spark, twin, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.SQL:
        assert rows(got) == rows(twin.sql(catalog.SQL[name]).df())
    else:
        assert len(got) > 0


def test_entry(spark):
    assert catalog.entry(spark, SF).count() > 0


def test_the_library_does_without_the_training_operators():
    import pathlib
    import re

    root = pathlib.Path(catalog.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"tarnmill\.llm|corpus_pipeline", path.read_text()), path
