"""Registered queries of the corpus operators beside their SQL twins on whole tables."""

import pytest

from oracle_check import compare, duck
from vitrine.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(name, spark):
    ok, why, rows = compare(QUERIES[name](spark, SF), duck(SF), ORACLES[name])
    assert ok and (rows or name == "op2_decontamination"), why
