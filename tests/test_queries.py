import math
from pathlib import Path

import duckdb
import pytest

from tallyfold.plans import records  # noqa: F401  adds its queries
from tallyfold.plans.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    return value


@pytest.mark.skipif(not DATA.exists(), reason="the given tables aren't here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, name):
    frame = QUERIES[name](spark, str(DATA))
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    if name not in ORACLES:
        assert got
        return
    with duckdb.connect() as db:
        for t in TABLES:
            db.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
        want = db.sql(ORACLES[name])
        names = want.columns
        assert sorted(names) == columns
        assert sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall()), key=repr) == got
