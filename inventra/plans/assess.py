"""Risk, policy and compliance of an inventory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inventra.functions.text import is_model_pinned
from inventra.schema import MODEL_TYPES, RISK_FLAGS, SEVERITIES, blank, full, rank


def severity_of(score: Column) -> Column:
    return F.when(score >= 76, "critical").when(score >= 51, "high").when(score >= 26, "medium").when(score > 0, "low").otherwise("info")


def risk_flags(c: DataFrame) -> DataFrame:
    """One row per component and flag: secrets, servers without a framework,
    unpinned models, and known flags that scanners noted."""
    t = F.col("component_type")
    own = F.array(
        F.when(t == "secret", F.lit("hardcoded_api_key")),
        F.when((t == "mcp_server") & blank(F.col("framework")), F.lit("mcp_unknown_server")),
        F.when(t.isin(*MODEL_TYPES) & ~blank(F.col("model_name")) & ~is_model_pinned(F.col("model_name")), F.lit("unpinned_model")))
    noted = F.filter(F.split(F.coalesce(F.col("metadata")["risk_flags"], F.lit("")), ","), lambda f: f.isin(*RISK_FLAGS))
    return c.select("source", "instance_id", "file_path", "line_number", F.explode(F.concat(F.filter(own, lambda f: f.isNotNull()), noted)).alias("flag"))


def weighted(flags: DataFrame, overrides: dict[str, int] | None = None) -> DataFrame:
    weights = {k: (overrides or {}).get(k, w) for k, (w, _) in RISK_FLAGS.items()}
    weight, severity = F.lit(0), F.lit("info")
    for k, w in weights.items():
        weight, severity = F.when(F.col("flag") == k, w).otherwise(weight), F.when(F.col("flag") == k, RISK_FLAGS[k][1]).otherwise(severity)
    return flags.withColumn("weight", weight).withColumn("severity", severity)


def risk_score(flags: DataFrame, by: str) -> DataFrame:
    """Sum of weights, 100 at most, and its severity."""
    score = F.least(F.lit(100), F.sum("weight"))
    return flags.groupBy(by).agg(score.cast("int").alias("score"), F.count("*").alias("flags"), F.max(rank(F.col("severity"))).alias("worst")).withColumn("severity", severity_of(F.col("score")))


def compliance(c: DataFrame, r: DataFrame, score: int = 0, flags: int = 0, assessed: bool = False) -> DataFrame:
    """The fifteen requirements as rows (requirement, status).  Components meet
    their edges once; all checks are aggregates over that one pass, and its one
    row is turned into rows."""
    t = F.col("component_type")
    edge = lambda side, kind: r.where(F.col("relationship_type") == kind).select(F.col(f"{side}_instance_id").alias("instance_id")).distinct()
    guard_ids = c.where(t == "guardrail").select("instance_id")
    g = r.where("relationship_type = 'USES_GUARDRAIL'")
    ends = g.select(F.col("source_instance_id").alias("a"), F.col("target_instance_id").alias("b"))
    ends = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
    guarded = ends.join(guard_ids, ends.b == guard_ids.instance_id, "left_semi").select(F.col("a").alias("instance_id")).distinct()
    own = c
    for name, ids in {"guards": edge("source", "USES_GUARDRAIL"), "observes": edge("source", "OBSERVES"), "used": edge("target", "USES_TOOL"), "guarded": guarded}.items():
        own = own.join(ids.withColumn(f"_{name}", F.lit(True)), "instance_id", "left")
    some = lambda x: F.coalesce(F.bool_or(F.coalesce(x, F.lit(False))), F.lit(False))
    lacks = lambda name: F.col(f"_{name}").isNull()
    model, agent, tool, server = t.isin(*MODEL_TYPES), t == "agent", t == "tool", t == "mcp_server"
    always, risky = F.lit(True), F.lit(score == 0 and flags == 0 and not assessed)
    sure = F.coalesce("agentic_confidence", "heuristic_confidence") >= 0.8
    # What a requirement applies to, and what fails it.
    checks = {
        "eu-1": (some(model), some(model & blank(F.col("model_name")))), "eu-2": (some(t == "training_run"), ~some(t == "dataset")), "eu-3": (always, risky),
        "eu-4": (some(agent), some(agent & lacks("guards"))), "eu-5": (always, some(F.col("needs_agentic"))),
        "owasp-1": (some(agent), some(agent & blank(F.col("description")) & blank(F.col("framework")))), "owasp-2": (some(tool), some(tool & lacks("used"))),
        "owasp-3": (some(server), some(server & lacks("guarded"))), "owasp-4": (some((t == "secret") & sure), always), "owasp-5": (some(agent), some(agent & lacks("observes"))),
        "nist-1": (always, ~some(t != "other")), "nist-2": (some(model), some(model & ~is_model_pinned(F.coalesce(full(F.col("model_name")), F.col("name"))))),
        "nist-3": (some(t == "dataset"), some((t == "dataset") & blank(F.col("dataset_source")))), "nist-4": (some(agent), ~some(t == "observability")), "nist-5": (always, risky),
    }
    status = [F.struct(F.lit(name).alias("requirement"), F.when(~applies, "not_applicable").when(fails, "fail").otherwise("pass").alias("status")) for name, (applies, fails) in checks.items()]
    return own.agg(F.array(*status).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def coverage(checks: DataFrame) -> DataFrame:
    """Share of passed among decided requirements by framework, 100 if none."""
    p, f = F.count_if(F.col("status") == "pass"), F.count_if(F.col("status") == "fail")
    return checks.groupBy(F.split_part("requirement", F.lit("-"), F.lit(1)).alias("framework")).agg(p.alias("passed"), f.alias("failed"), F.when(p + f > 0, F.round(100 * p / (p + f), 2)).otherwise(100.0).alias("coverage"))


# Policy rules with their usual severity, and the parameter that a shorthand gives.
RULES = {"no_hardcoded_keys": "critical", "require_pinned_models": "high", "max_risk_score": "high", "blocked_models": "high", "require_guardrail_for": "medium", "require_observability_for": "medium", "max_unresolved_agentic": "medium"}
SHORTHAND = {"max_risk_score": "threshold", "blocked_models": "models", "require_guardrail_for": "component_types", "require_observability_for": "component_types", "max_unresolved_agentic": "max"}


def load_policy(doc: dict) -> tuple[list[tuple[str, dict, str]], str | None]:
    """Rules as (rule, parameters, severity) and fail_on.  A ``rules`` list makes
    the shorthand keys void; what isn't a rule, a list or a mapping where one
    belongs raises."""
    fail_on = str(doc["fail_on"]).lower() if doc.get("fail_on") is not None else None
    if fail_on is not None and fail_on not in SEVERITIES:
        raise ValueError(f"unknown severity {fail_on}")
    if doc.get("rules") is not None:
        out = []
        for r in doc["rules"]:
            severity = str(r.get("severity") or RULES[r["rule"]]).lower()
            if r["rule"] not in RULES or severity not in SEVERITIES or not isinstance(r.get("params") or {}, dict):
                raise ValueError(f"not a rule: {r}")
            out.append((r["rule"], r.get("params") or {}, severity))
        return out, fail_on
    out = []
    for k, severity in RULES.items():
        given = doc.get(k)
        if k not in SHORTHAND:
            out += [(k, {}, severity)] if given else []
        elif given is not None:
            if k.startswith(("blocked", "require")) and not isinstance(given, list):
                raise ValueError(f"{k} must be a list")
            out.append((k, {SHORTHAND[k]: given if isinstance(given, list) else int(given)}, severity))
    return out, fail_on


def policy_violations(c: DataFrame, rules: list[tuple[str, dict, str]], score: int = 0) -> DataFrame:
    """rule, severity, subject: one row per violation.  Rules on single components
    are one pass over them; rules on the whole inventory one aggregate."""
    t, name = F.col("component_type"), F.col("model_name")
    related = t.isin(*MODEL_TYPES)
    row = lambda rule, severity, subject: F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), subject.alias("subject"))
    own, whole = [], []
    for rule, p, severity in rules:
        if rule == "no_hardcoded_keys":
            own.append(F.when(t == "secret", row(rule, severity, F.col("name"))))
        elif rule == "require_pinned_models":
            own.append(F.when(related & ~is_model_pinned(name), row(rule, severity, F.col("name"))))
        elif rule == "blocked_models":
            bad = reduce(lambda a, b: a | b, [F.lower(name).contains(str(m).lower()) for m in p.get("models") or []], F.lit(False))
            own.append(F.when(related & ~blank(name) & bad, row(rule, severity, F.col("name"))))
        elif rule in ("require_guardrail_for", "require_observability_for"):
            kind = "guardrail" if "guardrail" in rule else "observability"
            for wanted in p.get("component_types") or []:
                lacks = F.bool_or(t == str(wanted).strip().lower()) & ~F.bool_or(t == kind)
                whole.append(F.when(lacks, row(rule, severity, F.lit(str(wanted).strip().lower()))))
        elif rule == "max_risk_score":
            whole.append(F.when(F.lit(score > int(p["threshold"])), row(rule, severity, F.lit("score"))))
        else:
            whole.append(F.when(F.count_if("needs_agentic") > int(p["max"]), row(rule, severity, F.lit("unresolved"))))
    none = F.lit(None).cast("struct<rule:string,severity:string,subject:string>")
    single = c.select(F.explode(F.array_compact(F.array(none, *own))).alias("v"))
    joint = c.agg(F.array_compact(F.array(none, *whole)).alias("vs")).select(F.explode("vs").alias("v"))
    return single.unionByName(joint).select("v.*")


def policy_passes(violations: DataFrame, fail_on: str | None) -> bool:
    """No violation, or none as severe as ``fail_on``; without it any fails."""
    bad = violations if fail_on is None else violations.where(rank(F.col("severity")) >= SEVERITIES.index(fail_on))
    return bad.isEmpty()


def type_breakdown(c: DataFrame) -> DataFrame:
    """Components by type with their share of the largest type."""
    n = c.where(~F.coalesce(F.col("test_only"), F.lit(False))).groupBy("component_type").agg(F.count("*").alias("n"))
    # One row per type: a window over types is a window over a fixed domain.
    return n.select("component_type", "n", F.round(100 * F.col("n") / F.max("n").over(Window.partitionBy()), 2).alias("pct"))


# What coverage is shown for.
COVERED = ("agent", "mcp_server", "tool")


def coverage_by_type(c: DataFrame, r: DataFrame) -> DataFrame:
    """How many agents, servers and tools have an edge, in either direction, to a
    guardrail or of its kind, and to observability or of its kinds."""
    kinds = c.select(F.col("instance_id").alias("b"), F.col("component_type").alias("peer"))
    one = r.select(F.col("source_instance_id").alias("a"), F.col("target_instance_id").alias("b"), "relationship_type")
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "relationship_type")).join(kinds, "b", "left")
    k, peer = F.col("relationship_type"), F.coalesce("peer", F.lit(""))
    marks = both.groupBy(F.col("a").alias("instance_id")).agg(F.bool_or((k == "USES_GUARDRAIL") | (peer == "guardrail")).alias("guarded"), F.bool_or(k.isin("LOGS_TO", "OBSERVES") | (peer == "observability")).alias("observed"))
    out = c.where(F.col("component_type").isin(*COVERED)).join(marks, "instance_id", "left")
    return out.groupBy("component_type").agg(F.count("*").alias("n"), F.count_if("guarded").alias("guarded"), F.count_if("observed").alias("observed"))


def model_inventory(c: DataFrame) -> DataFrame:
    return c.where(F.col("component_type").isin(*MODEL_TYPES)).select("file_path", "name", F.coalesce(full(F.col("model_name")), F.col("name")).alias("model"), "framework").orderBy("file_path", "name")


def vulnerabilities(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """The worst advisory of each (ecosystem, name, version) with its weight."""
    j = packages.join(advisories, ["ecosystem", "name", "version"])
    top = j.groupBy("ecosystem", "name", "version").agg(F.max(rank(F.col("severity"))).alias("worst"), F.count("*").alias("advisories"))
    return top.withColumn("weight", F.element_at(F.array(*map(F.lit, (1, 5, 10, 20, 25))), F.col("worst") + 1))


def empty_components(spark: SparkSession) -> DataFrame:
    from inventra.schema import COMPONENTS

    return spark.createDataFrame([], COMPONENTS)
