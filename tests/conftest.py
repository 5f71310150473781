import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for path in (ROOT, os.path.join(ROOT, "scripts")):
    if path not in sys.path:
        sys.path.insert(0, path)

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from vitrine.session import local_session

    return local_session("tests", "4", 4)


@pytest.fixture(scope="session")
def tables(spark):
    from vitrine.registry import Tables

    return Tables(spark, SF)
