"""Every registered query against its SQL twin on whole tables."""

import pytest

from conftest import SF
from oracle_check import compare, duck
from vitrine.registry import REGISTRY


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.sql])
def test_query_matches_sql(name, tables, con):
    ok, why, rows = compare(REGISTRY[name].build(tables), con, REGISTRY[name].sql)
    assert ok, why


def test_every_survey_id_has_a_query():
    expected = {f"{f}{i}" for f, n in zip("ABCDEFGHIJK", (10, 17, 14, 5, 12, 17, 8, 10, 19, 9, 7)) for i in range(1, n + 1)}
    covered = {i for q in REGISTRY.values() for i in q.ids.split(",")}
    assert expected - covered == set()
