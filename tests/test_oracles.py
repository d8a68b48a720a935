"""Every registered query against its oracle on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import check_oracles
from trendline.catalog.oracles import ORACLES
from trendline.catalog.queries import QUERIES



@pytest.fixture(scope="module")
def connection(sf_dir):
    return check_oracles.connect(sf_dir)


def test_every_query_has_an_oracle():
    assert sorted(QUERIES) == sorted(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query_agrees(name, spark, sf_dir, connection):
    result = QUERIES[name](spark, sf_dir)
    assert check_oracles.compare(result, connection.execute(ORACLES[name])) is None


def test_entry(spark, sf_dir):
    result = entry.entry(spark)
    assert len(result.columns) == 21
    assert result.count() > 0
