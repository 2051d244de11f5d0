"""Whole documents that no one process has to hold.

A document is a table of *pieces*: its text in order, and what goes between two
pieces of one list.  Spark deals the pieces out by range of their place; each task
writes its own part beside the document, and the commit joins the parts in order,
a little at a time.  A task that runs twice leaves a part that no commit names."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from inventra.plans.assess import type_breakdown
from inventra.sinks.reports import CSV, confidence, csv_rows, cyclonedx_rows, junit_rows, sarif_rows, spdx_rows

#: place: a piece's place in the document; glue: what goes before it where the
#: piece before it leaves the list that it enters.
PIECES = "place array<string>, text string, glue string, enter string, leave string"
_CHUNK = 1 << 20


@dataclass
class _Part(WriterCommitMessage):
    number: int
    path: str
    #: Glue and list of the first piece, list of the last; none for no pieces.
    glue: str | None
    enter: str | None
    leave: str | None


class DocumentWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.parts = path, f"{path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> _Part:
        task = TaskContext.get()
        place = f"{self.parts}/{task.partitionId()}-{task.taskAttemptId()}"
        files, local = pyarrow.fs.FileSystem.from_uri(place)
        files.create_dir(local.rsplit("/", 1)[0], recursive=True)
        first = last = None
        with files.open_output_stream(local) as out:
            for piece in iterator:
                if first is None:
                    first = piece
                elif piece.glue and last.leave == piece.enter:
                    out.write(piece.glue.encode())
                out.write((piece.text or "").encode())
                last = piece
        return _Part(task.partitionId(), place, first and first.glue, first and first.enter, last and last.leave)

    def commit(self, messages: list) -> None:
        files, local = pyarrow.fs.FileSystem.from_uri(self.path)
        files.create_dir(local.rsplit("/", 1)[0], recursive=True)
        leave = None
        with files.open_output_stream(f"{local}.new") as out:
            for part in sorted((m for m in messages if m is not None and m.enter is not None), key=lambda m: m.number):
                if part.glue and leave == part.enter:
                    out.write(part.glue.encode())
                with files.open_input_stream(pyarrow.fs.FileSystem.from_uri(part.path)[1]) as held:
                    while chunk := held.read(_CHUNK):
                        out.write(chunk)
                leave = part.leave
        files.move(f"{local}.new", local)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        files, local = pyarrow.fs.FileSystem.from_uri(self.parts)
        if files.get_file_info(local).type != pyarrow.fs.FileType.NotFound:
            files.delete_dir(local)


class DocumentSource(DataSource):
    """``df.write.format("document").save(uri)`` for a table of pieces."""

    @classmethod
    def name(cls) -> str:
        return "document"

    def schema(self) -> str:
        return PIECES

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"])


def write_pieces(pieces: DataFrame, uri: str) -> None:
    """Writes a document from its pieces; ``uri`` names a file that all executors
    and the driver reach, such as file:///shared/report.json."""
    spark = pieces.sparkSession
    spark.dataSource.register(DocumentSource)
    pieces.orderBy("place").write.format("document").mode("overwrite").save(uri)


def _n(value: Column) -> Column:
    """A number, not negative, as text that sorts like it."""
    return F.lpad(value.cast("string"), 20, "0")


def _pieces(df: DataFrame, place: list, text: Column, glue: str = "", enter: Column | str = "", leave: Column | str | None = None) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    places = F.array(*(lit(p).cast("string") for p in place))
    return df.select(places.alias("place"), text.alias("text"), F.lit(glue).alias("glue"), lit(enter).alias("enter"), lit(enter if leave is None else leave).alias("leave"))


def _fixed(df: DataFrame, *texts: tuple[str, str]) -> DataFrame:
    """Texts that always stand, by place."""
    return df.sparkSession.createDataFrame([([place], text, "", "fixed", "fixed") for place, text in texts], PIECES)


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _json(value: Column) -> Column:
    """A value alone as JSON: what stands in an array of it."""
    whole = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


DOCUMENTS: dict[str, Callable[..., DataFrame]] = {}


def document(name: str):
    """Registers what makes the pieces of a format."""

    def add(f):
        DOCUMENTS[name] = f
        return f

    return add


def write_document(c: DataFrame, uri: str, kind: str, **more) -> None:
    write_pieces(DOCUMENTS[kind](c, **more), uri)


@document("csv")
def csv_document(c: DataFrame, **_) -> DataFrame:
    quoted = lambda x: F.when(x.rlike("[\",\r\n]"), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    text = F.concat(F.concat_ws(",", *(quoted(F.col(x).cast("string")) for x in CSV)), F.lit("\n"))
    return _all(_fixed(c, ("0", ",".join(CSV) + "\n")), _pieces(csv_rows(c), ["1", F.col("component_type"), F.col("name"), F.col("file_path"), _n(F.col("line_number"))], text))


@document("plaintext")
def plain_document(c: DataFrame, **_) -> DataFrame:
    kind = F.when(F.length("component_type") < 20, F.rpad("component_type", 20, " ")).otherwise(F.col("component_type"))
    text = F.concat(kind, F.lit(" "), F.col("name"), F.lit("  "), F.coalesce("file_path", F.lit("")), F.lit(":"), F.coalesce("line_number", F.lit(0)).cast("string"), F.lit("\n"))
    return _pieces(c, [F.col("component_type"), F.col("name"), _n(F.col("ord"))], text)


@document("markdown")
def markdown_document(c: DataFrame, **_) -> DataFrame:
    cell = lambda x: F.replace(F.replace(F.coalesce(F.col(x).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    heads = c.select("component_type").distinct()
    head = F.concat(F.lit("\n## "), F.col("component_type"), F.lit("\n\n| name | file | line | framework |\n|-|-|-|-|\n"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, ("name", "file_path", "line_number", "framework"))), F.lit(" |\n"))
    return _all(_fixed(c, ("0", "# Assets\n")), _pieces(heads, ["1", F.col("component_type"), "0"], head), _pieces(c, ["1", F.col("component_type"), "1", F.col("name"), _n(F.col("ord"))], line))


@document("cyclonedx")
def cyclonedx_document(c: DataFrame, **_) -> DataFrame:
    rows = cyclonedx_rows(c)
    properties = F.transform("properties", lambda p: F.struct(F.regexp_extract(p, "(?s)^(.*?)=", 1).alias("name"), F.regexp_extract(p, "(?s)^.*?=(.*)$", 1).alias("value"))).alias("properties")
    part = F.struct(F.col("class").alias("type"), F.col("ref").alias("bom-ref"), "name", "description", properties)
    secret = F.struct(F.concat(F.lit("asset-secret-"), "ref").alias("id"), "description", properties)
    by = [F.col("class"), F.col("name"), F.col("ref")]
    return _all(
        _fixed(c, ("0", '{"bomFormat": "CycloneDX", "specVersion": "1.6", "version": 1, "components": ['), ("2", '], "vulnerabilities": ['), ("4", "]}")),
        _pieces(rows.where("class <> 'vulnerability'"), ["1", *by], _json(part), ", ", "parts"), _pieces(rows.where("class = 'vulnerability'"), ["3", *by], _json(secret), ", ", "secrets"),
    )


@document("sarif")
def sarif_document(c: DataFrame, flags: DataFrame | None = None, **_) -> DataFrame:
    rows = sarif_rows(c, flags)
    region = F.when(F.col("line").isNotNull() & (F.col("line") != 0), F.concat(F.lit(', "region": {"startLine": '), F.col("line").cast("string"), F.lit("}"))).otherwise("")
    place = F.when(F.col("file").isNotNull(), F.concat(F.lit('{"physicalLocation": {"artifactLocation": {"uri": '), _json(F.col("file")), F.lit("}"), region, F.lit("}}"))).otherwise("")
    text = F.concat(F.lit('{"ruleId": '), _json(F.col("rule")), F.lit(', "level": '), _json(F.col("level")), F.lit(', "message": {"text": '), _json(F.col("message")), F.lit('}, "locations": ['), place, F.lit("]}"))
    rules = rows.select("rule").distinct()
    return _all(
        _fixed(c, ("0", '{"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": "inventra", "rules": ['), ("2", ']}}, "results": ['), ("4", "]}]}")),
        _pieces(rules, ["1", F.col("rule")], F.concat(F.lit('{"id": '), _json(F.col("rule")), F.lit("}")), ", ", "rules"),
        _pieces(rows, ["3", F.col("rule"), F.col("message"), F.col("file"), _n(F.col("line"))], text, ", ", "results"),
    )


@document("spdx")
def spdx_document(c: DataFrame, **_) -> DataFrame:
    rows, by = spdx_rows(c), [F.col("element"), F.col("name"), F.col("id")]
    told = F.when(F.col("element") == "ai_AIPackage", "typeOfModel").when(F.col("element") == "dataset_DatasetPackage", "datasetType").otherwise("primaryPurpose")
    text = F.concat(F.lit('{"spdxId": '), _json(F.col("id")), F.lit(', "type": '), _json(F.col("element")), F.lit(', "name": '), _json(F.col("name")), F.lit(', "'), told, F.lit('": '), _json(F.col("purpose")), F.lit("}"))
    return _all(
        _fixed(c, ("0", '{"@context": "https://spdx.org/rdf/3.0.1/spdx-context.jsonld", "@graph": [{"type": "SpdxDocument", "spdxId": "urn:spdx:asset-document", "element": ['), ("2", "]}"), ("4", "]}")),
        _pieces(rows, ["1", *by], _json(F.col("id")), ", ", "ids"), _pieces(rows, ["3", *by], F.concat(F.lit(", "), text)),
    )


@document("junit")
def junit_document(c: DataFrame, flags: DataFrame | None = None, threshold: str = "medium", **_) -> DataFrame:
    plain = c.select(F.lit("component").alias("class"), F.concat(F.lit("component_"), "instance_id").alias("case"), F.lit(False).alias("failed"))
    rows = plain if flags is None else junit_rows(c, flags, threshold)
    escaped = lambda x: F.concat(F.lit('"'), F.replace(F.replace(F.replace(F.replace(F.col(x), F.lit("&"), F.lit("&amp;")), F.lit(">"), F.lit("&gt;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;")), F.lit('"'))
    text = F.concat(F.lit("<testcase classname="), escaped("class"), F.lit(" name="), escaped("case"), F.lit(">"), F.when(F.col("failed"), "<failure/>").otherwise(""), F.lit("</testcase>"))
    counts = rows.agg(F.count("*").alias("n"), F.count_if("failed").alias("failed"))
    head = F.format_string('<testsuite name="assets" tests="%d" failures="%d">', "n", "failed")
    return _all(_pieces(counts, ["0"], head), _pieces(rows, ["1", F.col("class"), F.col("case")], text), _fixed(c, ("2", "</testsuite>")))


@document("json")
def json_document(c: DataFrame, edges: DataFrame | None = None, **_) -> DataFrame:
    rows = c.withColumn("confidence", confidence())
    fields = ("name", "file_path", "line_number", "framework", "model_name", "confidence", "instance_id")
    source, kind = F.col("source"), F.col("component_type")
    kinds = rows.select("source", "component_type").distinct()
    sources = kinds.select("source").distinct()
    of = F.concat(F.lit("of "), source)
    opened = lambda x, mark: F.concat(_json(x), F.lit(f": {mark}"))
    out = [
        _fixed(c, ("0", '{"relationships": ['), ("2", '], "sources": {'), ("4", "}}")),
        _pieces(sources, ["3", source, "0"], opened(source, "{"), ", ", "sources", F.concat(F.lit("in "), source)), _pieces(sources, ["3", source, "2"], F.lit("}"), "", "", "sources"),
        _pieces(kinds, ["3", source, "1", kind, "0"], opened(kind, "["), ", ", of, "opened"), _pieces(kinds, ["3", source, "1", kind, "2"], F.lit("]"), "", "", of),
        _pieces(rows, ["3", source, "1", kind, "1", F.col("name"), _n(F.col("ord"))], _json(F.struct(*fields)), ", ", "items"),
    ]
    if edges is not None:
        by = ("source_instance_id", "target_instance_id", "relationship_type")
        out.append(_pieces(edges, ["1", *(F.col(x) for x in by)], _json(F.struct(*edges.columns)), ", ", "edges"))
    return _all(*out)


def _escaped(x: Column) -> Column:
    for given, told in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(given), F.lit(told))
    return x


@document("html")
def html_document(c: DataFrame, **_) -> DataFrame:
    cells = lambda *x: F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), v, F.lit("</td>")) for v in x), F.lit("</tr>"))
    share = type_breakdown(c)
    return _all(
        _fixed(c, ("0", "<!DOCTYPE html><html><head><meta charset='utf-8'><title>Assets</title></head><body><table>"), ("2", "</table><table>"), ("4", "</table></body></html>")),
        _pieces(share, ["1", F.col("component_type")], cells(_escaped(F.col("component_type")), F.col("n").cast("string"), F.concat(F.col("pct").cast("string"), F.lit("%")))),
        _pieces(c, ["3", F.col("file_path"), F.col("name")], cells(_escaped(F.coalesce("name", F.lit("None"))), _escaped(F.col("component_type")), _escaped(F.coalesce("file_path", F.lit(""))))),
    )
