"""COVERAGE.md names queries that exist, marks those without SQL, and lists every id of the survey's inventory that is not left out."""

import re
from pathlib import Path

from quarry.plans import catalogue

ROOT = Path(__file__).parents[1]


def test_every_id_has_queries_or_tests():
    rows = re.findall(r"^\| ([A-Z]{3}\d+) \| ([^|]+) \| ([^|]*) \|$", (ROOT / "COVERAGE.md").read_text(), re.M)
    assert len(rows) == len({i for i, _, _ in rows}) >= 224
    for i, cell, code in rows:
        named = re.findall(r"`(\w+)`(\*?)", cell)
        assert named or (ROOT / cell.strip()).exists(), i
        for name, star in named:
            assert name in catalogue.QUERIES and (name in catalogue.ORACLE_SQL) == (star == ""), (i, name)
        assert (ROOT / code.strip()).exists(), i


def test_queries_without_sql_are_few():
    """BLAKE2b has no form in SQL."""
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == {"hsh_place", "join_asof_ring", "met_hash_distribution", "met_ring_distribution"}
