"""Every registered query with SQL gives what DuckDB gives."""

import math
import os

import duckdb
import pytest

from lectern.plans.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    return str(float(value)) if isinstance(value, float) else str(value)


def rows(frame, names):
    return sorted(tuple(map(plain, r)) for r in frame[names].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def db():
    found = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        path = f"{found}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con, found


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    con, folder = db
    got = QUERIES[name](spark, folder).toPandas()
    if name not in ORACLE_SQL:
        assert len(got) > 0
        return
    want = con.execute(ORACLE_SQL[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert rows(got, names) == rows(want, names)


def test_modes_seed_from_every_row(spark, db):
    """Against a plain version; mix has the naive part's documents whatever their ids."""
    import re
    from collections import defaultdict

    con, folder = db
    names = lambda text: re.findall("[A-Z][a-z]+", text or "")
    seeds = {x for (text,) in con.execute("SELECT text FROM benchmark").fetchall() for x in names(text)}
    found = {k: sorted({x for x in names(text) if len(x) >= 4}) for k, text in con.execute("SELECT doc_id, text FROM documents").fetchall()}
    around = defaultdict(set)
    for xs in found.values():
        for a, b in zip(xs, xs[1:], strict=False):
            around[a].add(b)
            around[b].add(a)
    reach = seeds | {y for x in seeds for y in around[x]}
    local = {k: float(n) for k, xs in found.items() if (n := len(reach & set(xs)))}
    assert {r.doc_id: r.score for r in QUERIES["local_expand_all"](spark, folder).collect()} == local
    mixed = {r.doc_id for r in QUERIES["mix_union_all"](spark, folder).collect()}
    vectors = {r.doc_id for r in QUERIES["naive_threshold"](spark, folder).selectExpr("query_id AS doc_id").collect()} & set(found)
    assert vectors <= mixed and any(k >= 50 for k in vectors)
