"""Every query of the catalogue that has SQL gives DuckDB's rows."""

import duckdb
import pytest

from tamarack.plans import compaction  # noqa: F401 (registers its queries)
from tamarack.plans.catalogue import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def rows(frame):
    return sorted(tuple(str(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, DIR).toPandas()
    if name in ORACLES:
        assert rows(got) == rows(db.sql(ORACLES[name]).df())
    else:
        assert len(got)
