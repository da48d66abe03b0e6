"""Paths within query texts."""

import pytest

from arbora.engine import Engine

BOOKS = [(1, "<l><b id='1'><t>A</t><a>X</a><a>Y</a></b><b id='2'><t>B</t></b></l>"), (2, "<l><b id='3'><t>C</t></b></l>")]


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark).register_documents("lib", spark.createDataFrame(BOOKS, "id long, x string"), "id", "x")


@pytest.mark.parametrize(
    "query,want",
    [
        ("doc('lib')//t", ["A", "B", "C"]),
        ("count(doc('lib')//b[a])", [1]),
        ("for $b in doc('lib')//b order by string($b/@id) descending return string($b/t)", ["C", "B", "A"]),
        ("for $b in doc('lib')//b for $a in $b/a order by string($a) return name($b) || string($a)", ["bX", "bY"]),
        ("for $b in doc('lib')//b order by string($b/@id) return count($b/a)", [2, 0, 0]),
        ("for $b in doc('lib')//b where $b/t = 'B' return string($b/@id)", ["2"]),
        ("for $t in doc('lib')/l/b[1]/t return local-name($t)", ["t", "t"]),
    ],
)
def test_paths_in_queries(engine, query, want):
    got = [r[0] for r in engine.query(query).collect()]
    assert (sorted(got) if "order by" not in query else got) == want
