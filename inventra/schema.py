"""Relations and domains of the asset inventory."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities from low to high, flag weights with their severity.
SEVERITIES = ("info", "low", "medium", "high", "critical")
RISK_FLAGS = {
    "hardcoded_api_key": (35, "high"), "mcp_unknown_server": (25, "high"), "unpinned_model": (10, "low"),
    "shadow_ai": (20, "medium"), "deprecated_model": (15, "medium"), "internet_facing": (20, "medium"), "no_auth": (25, "high"),
    "critical_cve": (40, "critical"), "high_cve": (25, "high"), "medium_cve": (10, "medium"), "known_exploit": (50, "critical"),
    "no_fix_available": (15, "medium"), "mcp_security_finding": (20, "high"), "skill_security_finding": (20, "high"),
}
MODEL_TYPES = ("model", "llm_endpoint", "model_endpoint")
CONTEXT_FREE_TYPES = ("dependency", "model", "model_artifact", "embedding")

COMPONENTS = """source string, name string, component_type string, file_path string, line_number int, framework string,
detection_source string, heuristic_confidence double, agentic_confidence double, needs_agentic boolean, agentic_hint string,
model_name string, embedding_model string, description string, text string, transport string, config_source string,
dataset_source string, metadata map<string,string>, instance_id string, ord long"""
RELATIONSHIPS = """source_instance_id string, target_instance_id string, relationship_type string, label string,
source_name string, target_name string, source_type string, target_type string, source_repo string, target_repo string, ord long"""
FILES = "root string, path string, content string, length long"


def rank(severity: Column) -> Column:
    """0 to 4; an unknown severity ranks as info."""
    out = F.lit(0)
    for i, s in enumerate(SEVERITIES):
        out = F.when(severity == s, i).otherwise(out)
    return out


def blank(c: Column) -> Column:
    """Null or empty, as one."""
    return F.coalesce(c, F.lit("")) == ""


def full(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def instance_id(name: Column, file_path: Column, line: Column, given: Column | None = None) -> Column:
    made = F.concat(F.coalesce(name, F.lit("")), F.lit("_"), F.coalesce(file_path, F.lit("")), F.lit("_"), F.coalesce(line, F.lit(0)).cast("string"))
    return made if given is None else F.coalesce(full(given), made)
