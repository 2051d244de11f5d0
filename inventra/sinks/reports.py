"""Reports of an inventory.  Rows are shaped in Spark; a document format is
written from rows in a declared order."""

from __future__ import annotations

import html
import json
from collections.abc import Callable
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inventra.schema import SEVERITIES, full, rank

REPORTERS: dict[str, Callable[..., str]] = {}


def reporter(name: str):
    """Registers a renderer under a format's name."""

    def add(f):
        REPORTERS[name] = f
        return f

    return add


def confidence() -> Column:
    return F.coalesce("agentic_confidence", "heuristic_confidence")


# Columns of the flat report.
CSV = ("name", "component_type", "file_path", "line_number", "framework", "detection_source", "model_name", "description", "instance_id")


def csv_rows(c: DataFrame) -> DataFrame:
    """The flat projection; nulls become empty."""
    return c.select(*(F.coalesce(x, F.lit(0) if x == "line_number" else F.lit("")).alias(x) for x in CSV))


def write_csv(c: DataFrame, path: str) -> None:
    csv_rows(c).write.mode("overwrite").option("header", True).csv(path)


def write_json(c: DataFrame, path: str) -> None:
    """One line per source and type, however large the inventory."""
    grouped(c).write.mode("overwrite").json(path)


def grouped(c: DataFrame) -> DataFrame:
    """Components by source and type, in order of name and ord."""
    rest = [x for x in c.columns if x not in ("source", "component_type", "name", "ord")]
    return c.groupBy("source", "component_type").agg(F.array_sort(F.collect_list(F.struct("name", "ord", *rest))).alias("components"))


def summary(c: DataFrame) -> DataFrame:
    """Components by type, without those of tests alone."""
    return c.where(~F.coalesce(F.col("test_only"), F.lit(False))).groupBy("component_type").agg(F.count("*").alias("n"))


def totals(c: DataFrame) -> DataFrame:
    """One row: sources, components without those of tests alone, how many these
    are, and how many of all rows, tests included, wait for review."""
    test = F.coalesce(F.col("test_only"), F.lit(False))
    return c.agg(F.countDistinct("source").alias("sources"), F.count_if(~test).alias("components"), F.count_if(test).alias("test_only"), F.count_if("needs_agentic").alias("pending"))


def component_summary(c: DataFrame) -> DataFrame:
    """source, component_type, name, file_path, line_number without tests, in
    order of source, type and name."""
    return c.where(~F.coalesce(F.col("test_only"), F.lit(False))).select("source", "component_type", "name", "file_path", "line_number").orderBy("source", "component_type", "name", "file_path", "line_number")


def _rows(c: DataFrame, *order: str) -> list[dict]:
    return [r.asDict(recursive=True) for r in c.orderBy(*order).toLocalIterator()]


# Classes and purposes of the exchange formats, by type.
CYCLONEDX = (
    ("machine-learning-model", ("model", "llm_endpoint", "model_endpoint", "embedding", "model_artifact")),
    ("library", ("tool", "dependency")), ("data", ("dataset", "vector_store")), ("file", ("skill",)),
)
CYCLONEDX_NATIVE = ("model", "llm_endpoint", "model_endpoint", "embedding", "model_artifact", "dataset", "vector_store")
SPDX_AI = ("model", "llm_endpoint", "model_endpoint", "embedding", "model_artifact", "training_run")
SPDX_PURPOSE = (
    ("application", ("agent", "mcp_server", "mcp_client", "skill")),
    ("library", ("tool", "dependency", "hyperparameter", "model_registry", "experiment_tracker", "ml_pipeline", "retriever")),
    ("data", ("vector_store", "memory", "data_versioning", "secret")),
)


def _by_type(table, default: str) -> Column:
    out = F.lit(default)
    for value, types in table:
        out = F.when(F.col("component_type").isin(*types), value).otherwise(out)
    return out


def described() -> Column:
    parts = F.concat_ws(" — ", "name", "component_type", full(F.col("framework")))
    return F.coalesce(full(F.col("description")), parts)


def cyclonedx_rows(c: DataFrame) -> DataFrame:
    """ref, name, class (vulnerability for a secret), description and properties
    (name=value, those that are there; the type only where the class doesn't tell it)."""
    kind = F.when(F.col("component_type") == "secret", "vulnerability").otherwise(_by_type(CYCLONEDX, "application"))
    have = lambda x: F.when(F.coalesce(F.col(x).cast("string"), F.lit("")).isin("", "0"), None).otherwise(F.concat(F.lit(f"{x}="), F.col(x).cast("string")))
    type_ = F.when(~F.col("component_type").isin(*CYCLONEDX_NATIVE), F.concat(F.lit("type="), "component_type"))
    return c.select(F.col("instance_id").alias("ref"), "name", kind.alias("class"), described().alias("description"), F.array_compact(F.array(type_, have("framework"), have("file_path"), have("line_number"))).alias("properties"))


def sarif_rows(c: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """rule, level, message, file and line (null without one) of each finding."""
    text = F.concat_ws(" ", F.concat(F.lit("component '"), "name", F.lit("' ("), "component_type", F.lit(")")), F.concat(F.lit("framework: "), full(F.col("framework"))), full(F.col("description")))
    place = (full(F.col("file_path")).alias("file"), F.when(~F.coalesce(F.col("file_path") == "", F.lit(True)) & (F.col("line_number") > 0), F.col("line_number")).alias("line"))
    own = c.select(F.concat(F.lit("asset/"), "component_type").alias("rule"), F.when(F.col("component_type") == "secret", "warning").otherwise("note").alias("level"), text.alias("message"), *place)
    if flags is None:
        return own
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim("flag")), "[^a-zA-Z0-9_-]+", "-"), "^-+|-+$", "")
    level = F.when(F.col("severity") == "critical", "error").when(F.col("severity").isin("high", "medium"), "warning").otherwise("note")
    risk = flags.select(F.concat(F.lit("asset/risk/"), F.when(slug == "", "finding").otherwise(slug)).alias("rule"), level.alias("level"), F.col("flag").alias("message"), *place)
    return own.unionByName(risk)


def spdx_rows(c: DataFrame) -> DataFrame:
    """id, element class, name and purpose (of models what they are a model of)."""
    kind = F.when(F.col("component_type").isin(*SPDX_AI), "ai_AIPackage").when(F.col("component_type") == "dataset", "dataset_DatasetPackage").otherwise("software_Package")
    told = F.when(kind == "ai_AIPackage", F.coalesce(full(F.col("model_name")), F.col("name"))).when(kind == "dataset_DatasetPackage", F.coalesce(full(F.col("description")), F.col("name"))).otherwise(_by_type(SPDX_PURPOSE, "file"))
    return c.select(F.concat(F.lit("urn:spdx:asset-"), "component_type", F.lit("-"), F.sha2("instance_id", 256)).alias("id"), kind.alias("element"), "name", told.alias("purpose"))


def junit_rows(c: DataFrame, flags: DataFrame, threshold: str = "medium") -> DataFrame:
    """Cases: each flag, failed when as severe as the threshold; and each
    component that no flag of its file (and, where the flag has one, line) names."""
    one = lambda prefix, x: F.substring(F.concat(F.lit(f"{prefix}_"), F.coalesce(full(F.regexp_replace(F.regexp_replace(x, r"[^\w.\-]+", "_"), "^_+|_+$", "")), F.lit("item"))), 1, 200)
    cases = flags.select(F.lit("risk").alias("class"), one("risk", F.col("flag")).alias("case"), (rank(F.col("severity")) >= SEVERITIES.index(threshold)).alias("failed"))
    f = flags.select(F.col("file_path").alias("_f"), F.col("line_number").alias("_l")).distinct()
    clean = c.join(f, (c.file_path == F.col("_f")) & ((F.col("_l") == 0) | (F.col("_l") == c.line_number)), "left_anti")
    return cases.unionByName(clean.select(F.lit("component").alias("class"), one("component", F.col("instance_id")).alias("case"), F.lit(False).alias("failed")))


@reporter("json")
def render_json(c: DataFrame, edges: DataFrame | None = None, **_) -> str:
    out: dict = {}
    for r in _rows(c.withColumn("confidence", confidence()), "source", "component_type", "name", "ord"):
        out.setdefault(r["source"], {}).setdefault(r["component_type"], []).append({k: r[k] for k in ("name", "file_path", "line_number", "framework", "model_name", "confidence", "instance_id")})
    links = [] if edges is None else _rows(edges, "source_instance_id", "target_instance_id", "relationship_type")
    return json.dumps({"sources": out, "relationships": links}, ensure_ascii=False, sort_keys=True)


@reporter("csv")
def render_csv(c: DataFrame, **_) -> str:
    import csv
    import io

    to = io.StringIO()
    w = csv.writer(to, lineterminator="\n")
    w.writerow(CSV)
    w.writerows(list(r.values()) for r in _rows(csv_rows(c), "component_type", "name", "file_path", "line_number"))
    return to.getvalue()


@reporter("cyclonedx")
def render_cyclonedx(c: DataFrame, **_) -> str:
    parts, found = [], []
    for r in _rows(cyclonedx_rows(c), "class", "name", "ref"):
        said = [dict(zip(("name", "value"), p.split("=", 1), strict=True)) for p in r["properties"]]
        if r["class"] == "vulnerability":
            found.append({"id": f"asset-secret-{r['ref']}", "description": r["description"], "properties": said})
        else:
            parts.append({"type": r["class"], "bom-ref": r["ref"], "name": r["name"], "description": r["description"], "properties": said})
    return json.dumps({"bomFormat": "CycloneDX", "specVersion": "1.6", "version": 1, "components": parts, "vulnerabilities": found}, ensure_ascii=False)


@reporter("sarif")
def render_sarif(c: DataFrame, flags: DataFrame | None = None, **_) -> str:
    results = []
    for r in _rows(sarif_rows(c, flags), "rule", "message", "file", "line"):
        region = {"region": {"startLine": r["line"]}} if r["line"] else {}
        place = [{"physicalLocation": {"artifactLocation": {"uri": r["file"]}, **region}}] if r["file"] else []
        results.append({"ruleId": r["rule"], "level": r["level"], "message": {"text": r["message"]}, "locations": place})
    rules = [{"id": x} for x in dict.fromkeys(r["ruleId"] for r in results)]
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": "inventra", "rules": rules}}, "results": results}]})


@reporter("spdx")
def render_spdx(c: DataFrame, **_) -> str:
    told = {"ai_AIPackage": "typeOfModel", "dataset_DatasetPackage": "datasetType", "software_Package": "primaryPurpose"}
    items = [{"spdxId": r["id"], "type": r["element"], "name": r["name"], told[r["element"]]: r["purpose"]} for r in _rows(spdx_rows(c), "element", "name", "id")]
    document = {"type": "SpdxDocument", "spdxId": "urn:spdx:asset-document", "element": [i["spdxId"] for i in items]}
    return json.dumps({"@context": "https://spdx.org/rdf/3.0.1/spdx-context.jsonld", "@graph": [document, *items]})


@reporter("markdown")
def render_markdown(c: DataFrame, **_) -> str:
    cell = lambda x: str("" if x is None else x).replace("|", "\\|").replace("\n", " ")
    out, kind = ["# Assets"], None
    for r in _rows(c, "component_type", "name", "ord"):
        if r["component_type"] != kind:
            kind = r["component_type"]
            out += ["", f"## {kind}", "", "| name | file | line | framework |", "|-|-|-|-|"]
        out.append(f"| {cell(r['name'])} | {cell(r['file_path'])} | {cell(r['line_number'])} | {cell(r['framework'])} |")
    return "\n".join(out) + "\n"


@reporter("plaintext")
def render_plaintext(c: DataFrame, **_) -> str:
    return "".join(f"{r['component_type']:<20} {r['name']}  {r['file_path'] or ''}:{r['line_number'] or 0}\n" for r in _rows(c, "component_type", "name", "ord"))


@reporter("junit")
def render_junit(c: DataFrame, flags: DataFrame | None = None, threshold: str = "medium", **_) -> str:
    """Each flag is a case, and each component without one."""
    rows = _rows(junit_rows(c, flags, threshold) if flags is not None else c.select(F.lit("component").alias("class"), F.concat(F.lit("component_"), "instance_id").alias("case"), F.lit(False).alias("failed")), "class", "case")
    cases = [f"<testcase classname={quoteattr(r['class'])} name={quoteattr(r['case'])}>{'<failure/>' if r['failed'] else ''}</testcase>" for r in rows]
    return f'<testsuite name="assets" tests="{len(cases)}" failures="{sum(r["failed"] for r in rows)}">' + "".join(cases) + "</testsuite>"


@reporter("html")
def render_html(c: DataFrame, **_) -> str:
    from inventra.plans.assess import type_breakdown

    bars = "".join(f"<tr><td>{html.escape(r['component_type'])}</td><td>{r['n']}</td><td>{r['pct']}%</td></tr>" for r in _rows(type_breakdown(c), "component_type"))
    rows = "".join(f"<tr><td>{html.escape(str(r['name']))}</td><td>{html.escape(r['component_type'])}</td><td>{html.escape(r['file_path'] or '')}</td></tr>" for r in _rows(c, "file_path", "name"))
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Assets</title></head><body><table>{bars}</table><table>{rows}</table></body></html>"


def api_components(c: DataFrame, type_: str | None = None, file_path: str | None = None) -> DataFrame:
    """The service's list: equal type, file path by regular expression."""
    out = c if type_ is None else c.where(F.col("component_type") == type_)
    return out if file_path is None else out.where(F.coalesce(F.col("file_path"), F.lit("")).rlike(file_path))


def api_types(c: DataFrame) -> DataFrame:
    return c.select(full(F.col("component_type")).alias("component_type")).distinct().where("component_type is not null").orderBy("component_type")
