"""The queries of the subpackage against their SQL, on the smallest data."""

import ast

import check_oracles
import pytest

from vacantia.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, name):
    assert check_oracles.compare(spark, check_oracles.connect(FOLDER), FOLDER, name) is None


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    registered = check_oracles.entry.queries()
    assert set(QUERIES) | {"pipeline"} <= set(registered)


def imported(path):
    """The modules that a file imports, with the names it takes from them."""
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            yield from (name.name for name in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield from (f"{node.module or ''}.{name.name}" for name in node.names)


def test_nothing_else_imports_the_subpackage():
    for path in (check_oracles.ROOT / "vacantia").rglob("*.py"):
        if "llm" not in path.relative_to(check_oracles.ROOT).parts:
            assert not [name for name in imported(path) if "llm" in name.split(".")]
