"""The node table, paths and updates over small documents."""

import pytest

from arbora.engine import ship
from arbora.operators import fulltext, nodes, sequences, updates, windows
from arbora.operators.paths import Paths, path_of
from arbora.sources import readers

BOOKS = "<library><book id='1'><title>A</title><author>X</author></book><book id='2'><title>B</title></book><!--end--><?p q?></library>"


@pytest.fixture(scope="module")
def books(spark):
    ship(spark)
    return readers.documents(spark.createDataFrame([(7, BOOKS), (8, "<r xmlns:a='u'><a:x>1</a:x><x>2</x></r>"), (9, None)], "id long, t string"), "id", "t").persist()


@pytest.mark.parametrize(
    "path,want",
    [
        ("//title", ["A", "B"]), ("/library/book[2]/title", ["B"]), ("//book/@id", ["1", "2"]), ("//book[@id = '1']/author", ["X"]), ("//book[author]/title", ["A"]), ("//book[not(author)]/title", ["B"]),
        ("//author/parent::book/@id", ["1"]), ("//author/ancestor::library/book[last()]/@id", ["2"]), ("//book[1]/following-sibling::book/title", ["B"]), ("//title[. = 'B']/preceding::author", ["X"]),
        ("//comment()", ["end"]), ("//text()", ["A", "X", "B", "1", "2"]), ("//a:x | //title", ["A", "B", "1"]), ("//book[contains(title, 'A') or @id = '2']/@id", ["1", "2"]), ("//*[@id][position() <= 1]/@id", ["1"]),
    ],
)
def test_paths(books, path, want):
    got = Paths(books).select(path).orderBy("doc_id", "pre").collect()
    assert [r["string_value"] for r in got] == want


def test_node_sets_and_functions(books):
    p = Paths(books)
    assert nodes.outermost(p.select("//*")).count() == 2
    assert nodes.innermost(p.select("//book | //title")).count() == 2
    assert nodes.intersect(p.select("//book"), p.select("//*[@id = '1']")).count() == 1
    assert {r["path"] for r in path_of(books, p.select("//title")).collect()} == {"/library[1]/book[1]/title[1]", "/library[1]/book[2]/title[1]"}
    assert {r["has_children"] for r in nodes.has_children(books, p.select("//title")).collect()} == {True}


def test_serialize_round_trip(books):
    text = {r["doc_id"]: r["text"] for r in nodes.serialize(books).collect()}
    assert text[7] == BOOKS.replace("'", '"')


def test_updates(books):
    p = Paths(books)
    edits = updates.edit("delete", p.select("//author")).union(updates.edit("rename", p.select("//title"), name="name")).union(updates.edit("insert-first", p.select("/library"), content="<x/>")).union(updates.edit("replace-value", p.select("//book[2]/title"), content="C"))
    text = {r["doc_id"]: r["text"] for r in nodes.serialize(updates.apply(books, edits)).collect()}
    assert text[7] == '<library><x/><book id="1"><name>A</name></book><book id="2"><name>C</name></book><!--end--><?p q?></library>'
    assert updates.delete(books, p.select("//book")).where("kind = 'element'").count() == 4


def test_bad_xml(spark):
    with pytest.raises(Exception, match="FODC0006"):
        readers.documents(spark.createDataFrame([(1, "<a>")], "id long, t string"), "id", "t").collect()
    assert readers.documents(spark.createDataFrame([(1, "<a>")], "id long, t string"), "id", "t", failing="drop").count() == 0


def test_policy(spark):
    with pytest.raises(Exception, match="FODC0002"):
        readers.unparsed_text(spark, "/etc/passwd", readers.Policy(["/data/"]))


def test_sequences(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "src long, dst long")
    assert sorted(r[0] for r in sequences.transitive_closure(spark.createDataFrame([(1,)], "item long"), edges).collect()) == [1, 2, 3]
    got = sequences.numbered(spark.range(50).selectExpr("50 - id as k"), ["k"]).orderBy("k").collect()
    assert [r["pos"] for r in got] == list(range(1, 51))


def test_islands(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate([1, 2, -3, -4, 5])], "g long, i long, x long")
    got = windows.islands(df, ["g"], ["i"], lambda before: (before("x") > 0) != (df["x"] > 0)).orderBy("i").collect()
    assert [r["window_id"] for r in got] == [1, 1, 2, 2, 3]


def test_index(spark, tmp_path):
    sequences.value_index(spark.range(1000).selectExpr("id as k"), str(tmp_path / "i"), "k", 4)
    assert sequences.index_lookup(spark, str(tmp_path / "i"), "k", equal=5).count() == 1
    assert sequences.index_lookup(spark, str(tmp_path / "i"), "k", low=10, high=20, include_low=False).count() == 10


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None)], "id long, t string")
    got = {r["doc"]: r["score"] for r in fulltext.bm25(fulltext.postings(docs, "id", "t"), ["a"]).collect()}
    assert list(got) == [1] and got[1] > 0
