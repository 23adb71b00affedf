"""Each query of the text operators that has SQL against it, on the smallest tables."""

import pytest

from spendframe.llm.oracles import oracle_sql
from spendframe.llm.queries import REGISTRY
from workload.check import connect, plain, sort_key


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, sf_dir, name):
    frame = REGISTRY[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(v) for v in row) for row in frame.select(*columns).collect()), key=sort_key)
    cursor = connect(sf_dir).execute(oracle_sql()[name])
    named = [c[0] for c in cursor.description]
    assert sorted(named) == columns
    want = sorted((tuple(plain(row[named.index(c)]) for c in columns) for row in cursor.fetchall()), key=sort_key)
    assert got == want and got
