import pytest

from coinloom.plans.queries import ORACLES, QUERIES

from .oracle import connect, same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    df = QUERIES[name](spark, sf_dir)
    if name not in ORACLES:
        assert df.count() > 0
        return
    ours, theirs = same(df, connect(sf_dir), ORACLES[name])
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    assert ours[1] == theirs[1]
