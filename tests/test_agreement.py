"""Registered queries against their DuckDB text; TIDEMARK_AGREE=all adds the iterative ones."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from agree import compare, duck

from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"
ITERATIVE = ("e", "g", "o6_outside_c", "o9", "o10", "o17", "l4", "b9", "j8", "j9", "x9", "x11_lead", "t5", "t6")
NAMES = [
    name
    for name in catalog.ORACLES
    if os.environ.get("TIDEMARK_AGREE") == "all" or not name.startswith(ITERATIVE) or name == "g2_staleness_cascade"
]

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_agrees(spark, con, name):
    assert compare(spark, con, name, SF).startswith("agrees")


def test_every_oracle_has_its_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
