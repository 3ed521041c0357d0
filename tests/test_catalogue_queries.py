import pytest

import __spark_entry__
import oracle
from tintlake import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf, name):
    assert oracle.difference(spark, queries.QUERIES[name], queries.ORACLES[name], sf) == ""


@pytest.mark.parametrize("name", ["palette_v1", "palette_v2", "palette_v3"])
def test_palettes_cover_posters(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    posters = queries.pixel_table(spark, sf).select("poster").distinct().count()
    got = df.collect()
    assert len(got) == posters
    first = "base" if name == "palette_v3" else "primary_hex"
    assert all(len(r[first]) == 7 and r[first][0] == "#" for r in got)
    if name == "palette_v3":
        assert {x for r in got for x in r.sources} >= {"base", "logo", "artwork"}


def test_entry(spark):
    assert 0 < __spark_entry__.entry(spark).count() <= 50
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
