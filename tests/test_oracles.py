"""Every query with SQL gives DuckDB's rows; those without give rows of a stable schema."""

import duckdb
import numpy as np
import pytest

from strandloom.plans.derived import constructs
from strandloom.plans.registry_all import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, (float, np.floating)) and np.isnan(v)):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    try:
        return f"{float(v):.6g}"
    except (TypeError, ValueError):
        return str(v)


def _rows(pdf):
    return sorted(tuple(_cell(v) for v in r) for r in pdf[sorted(pdf.columns)].values.tolist())


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_same_rows_as_sql(name, spark, sf, duck):
    mine, theirs = QUERIES[name].run(spark, sf).toPandas(), duck.execute(QUERIES[name].sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert _rows(mine) == _rows(theirs)


#: Queries without SQL, and what each gives over the smallest tables; ``test_kernels`` holds their kernels against brute force.
COLUMNS = {
    "direct_repeats": {"construct_id", "first", "second", "length", "spacer"},
    "g4_sites": {"construct_id", "name", "start", "end", "strand", "peak", "magnitude"},
    "homology_arms": {"construct_id", "arm_length", "arm", "tm", "unique"},
    "inverted_repeats": {"construct_id", "left", "right", "stem", "loop"},
    "near_perfect_repeats": {"construct_id", "first", "second", "length", "mismatches", "risk"},
    "insert_shared_repeats": {"construct_id", "first", "second", "length", "spacer"},
    "repeat_regions": {"construct_id", "start", "end", "pairs", "longest", "tandem", "risk"},
    "score_report": {"candidate", "report", "complete"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_bounds(name, spark, sf):
    """Rows name constructs that exist, and their positions lie on them."""
    got = QUERIES[name].run(spark, sf).toPandas()
    assert set(got.columns) >= COLUMNS[name]
    sizes = dict(constructs(spark, sf).select("construct_id", "length").collect())
    key = "candidate" if name == "score_report" else "construct_id"
    assert set(got[key]) <= set(sizes)
    for c in {"first", "second", "left", "right", "start", "end"} & set(got.columns):
        assert ((got[c] >= 0) & (got[c] <= got[key].map(sizes))).all()
    if name == "score_report":
        assert len(got) == len(sizes)
