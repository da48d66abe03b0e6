"""Sinks and streams."""

from arbora.engine import Engine
from arbora.sources import readers, writers
from arbora.streaming.continuous import continuous


def test_writers(spark, tmp_path):
    df = Engine(spark).query("for $x in 1 to 3 return map { 'k': $x, 's': string($x) }")
    for method in ("parquet", "json", "xml"):
        writers.write(df, str(tmp_path / method), method)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 3
    assert readers.json_doc(spark, str(tmp_path / "json"), "k long, s string").count() >= 1
    assert readers.xml_rows(spark, str(tmp_path / "xml"), "item", "k long, s string").count() == 3
    writers.write(Engine(spark).query("for $x in 1 to 3 return string($x)"), str(tmp_path / "text"), "text")
    assert sorted(r["item"] for r in readers.unparsed_lines(spark, str(tmp_path / "text")).collect()) == ["1", "2", "3"]


def test_continuous(spark, tmp_path):
    spark.range(20).selectExpr("id as k").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long").parquet(str(tmp_path / "in"))
    got = []
    q = continuous(Engine(spark), "t", stream, "for $r in collection('t') where $r?k ge 15 return $r?k", lambda df, _: got.extend(r[0] for r in df.collect()), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert sorted(got) == [15, 16, 17, 18, 19]
