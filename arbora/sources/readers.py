"""Sources: tables, text, JSON, XML and HTML documents as DataFrames, behind a policy of allowed places."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.operators.nodes import SCHEMA, VOID, Builder
from arbora.plans.parser import QueryError


class Policy:
    """Which places may be read: prefixes of URIs; none means all."""

    def __init__(self, allowed: list[str] | None = None):
        self.allowed = allowed

    def check(self, place: str) -> str:
        if self.allowed is not None and not any(place.startswith(a) for a in self.allowed):
            raise QueryError("FODC0002", f"{place} is not allowed")
        return place


def unparsed_text(spark: SparkSession, place: str, policy: Policy = Policy()) -> DataFrame:
    """(uri, text): a row per file."""
    return spark.read.text(policy.check(place), wholetext=True).select(F.input_file_name().alias("uri"), F.col("value").alias("text"))


def available(spark: SparkSession, place: str, policy: Policy = Policy()) -> bool:
    """Whether a place may be read and something is there."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(policy.check(place))
        return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path))
    except Exception:  # not allowed, no such store, no right to look
        return False


def unparsed_lines(spark: SparkSession, place: str, policy: Policy = Policy()) -> DataFrame:
    return spark.read.text(policy.check(place)).select(F.col("value").alias("item"))


def json_doc(spark: SparkSession, place: str, schema: str | None = None, policy: Policy = Policy()) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(policy.check(place))


def csv_doc(spark: SparkSession, place: str, schema: str, header: bool = True, policy: Policy = Policy()) -> DataFrame:
    return spark.read.schema(schema).csv(policy.check(place), header=header)


def xml_rows(spark: SparkSession, place: str, row_tag: str, schema: str, policy: Policy = Policy()) -> DataFrame:
    """Records of one element name, typed by a schema (the fast way to tables in XML)."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(policy.check(place))


def parse_xml(text: str) -> Builder:
    """Node rows of a well-formed document; raises FODC0006 otherwise."""
    b = Builder()
    p = expat.ParserCreate(namespace_separator=None)
    p.buffer_text = True
    scopes: list[dict[str, str]] = [{"xml": "http://www.w3.org/XML/1998/namespace"}]

    def start(name: str, attrs: dict[str, str]) -> None:
        own = {k[6:] if k.startswith("xmlns:") else "": v for k, v in attrs.items() if k == "xmlns" or k.startswith("xmlns:")}
        scopes.append({**scopes[-1], **own})
        b.start(name, {k: v for k, v in attrs.items() if k != "xmlns" and not k.startswith("xmlns:")}, scopes[-1])

    def end(_: str) -> None:
        scopes.pop()
        b.end()

    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, b.text
    p.CommentHandler = lambda t: b.leaf("comment", "", t)
    p.ProcessingInstructionHandler = lambda n, t: b.leaf("processing-instruction", n, t)
    try:
        p.Parse(text, True)
    except expat.ExpatError as e:
        raise QueryError("FODC0006", str(e)) from e
    b.close()
    return b


class _Html(HTMLParser):
    """Well-formed rows of any page: unclosed elements end with their parent, stray end tags are left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.b, self.open = Builder(), []

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and tag in self.open:
            stop = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "p": ("div", "td", "article", "section", "body", "li", "blockquote"), "option": ("select",)}[tag]
            above = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k] in stop), -1)
            if tag in self.open[above + 1 :]:
                self.handle_endtag(tag)
        self.b.start(tag, {k: v or "" for k, v in attrs}, {})
        if tag in VOID:
            self.b.end()
        else:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while True:
                self.b.end()
                if self.open.pop() == tag:
                    break

    def handle_data(self, data):
        self.b.text(data)

    def handle_comment(self, data):
        self.b.leaf("comment", "", data)


def parse_html(text: str) -> Builder:
    p = _Html()
    p.feed(text)
    p.close()
    for _ in p.open:
        p.b.end()
    p.b.close()
    return p.b


def documents(df: DataFrame, id_column: str, text_column: str, method: str = "xml", failing: str = "raise") -> DataFrame:
    """The node table of documents in a column; failing: raise, or drop documents that don't parse. Null texts have no nodes."""
    parse = parse_xml if method == "xml" else parse_html

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, t in zip(b.column(0), b.column(1)):
                if t.as_py() is None:
                    continue
                try:
                    own = parse(t.as_py()).rows
                except QueryError:
                    if failing == "raise":
                        raise
                    continue
                rows += [(i.as_py(), *r) for r in own]
                if len(rows) > 50_000:
                    yield Builder.batch(rows)
                    rows = []
            yield Builder.batch(rows)

    return df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(work, SCHEMA)
