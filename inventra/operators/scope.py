"""What stays in an inventory: predicates on components, and the gates before
and after review.  ``metadata`` is a map of strings; what is missing, empty or
"false" is no."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inventra.functions.packages import is_known
from inventra.functions.registry import is_embedding
from inventra.functions.text import bedrock_base, is_test_path, without_env_prefix
from inventra.schema import blank, full

_M = "metadata"


def said(key: str) -> Column:
    """Whether the metadata says something under a key."""
    return F.coalesce(~F.col(_M)[key].isin("", "false"), F.lit(False))


def is_import_only() -> Column:
    """Known from an import line alone."""
    return said("import_statement") & ~said("call_pattern")


def is_protected() -> Column:
    """A dependency that is a known package."""
    return (F.col("component_type") == "dependency") & said("known_ai_package")


def has_marker() -> Column:
    """Seen where it is made, not only where it is used."""
    return said("call_pattern") | said("assigned_to") | said("assigned_target") | said("kb_id")


def without_unresolved_candidates(c: DataFrame) -> DataFrame:
    """Without models that have no name and are known from the catalogue or as a
    bare client only."""
    open_ = (F.col("component_type") == "model") & blank(F.col("model_name")) & (said("partial_kb_id") | said("kb_id") | F.coalesce(F.col(_M)["detection_method"] == "bare_provider_client", F.lit(False)))
    return c.where(~open_)


def without_unresolved_classes(c: DataFrame) -> DataFrame:
    """Without models that name a client's class: bare clients, and catalogue
    rows of a class with the concept model."""
    bare = F.coalesce(F.col(_M)["detection_method"] == "bare_provider_client", F.lit(False))
    row = F.coalesce((F.col("detection_source") == "kb_enrichment") & (F.col("kb_label") == "class") & (F.col("kb_concept") == "model"), F.lit(False))
    return c.where(~((F.col("component_type") == "model") & blank(F.col("model_name")) & (bare | row)))


def secrets_apart(c: DataFrame, review: bool = False) -> tuple[DataFrame, DataFrame]:
    """What goes to review, and the secrets that are held back."""
    secret = F.lit(False) if review else F.col("component_type") == "secret"
    return c.where(~secret), c.where(secret)


def in_default_scope(c: DataFrame) -> DataFrame:
    return c.where(~F.coalesce(F.col("test_only"), F.lit(False)))


def known_dependencies_only(c: DataFrame) -> DataFrame:
    """Dependencies that are marked as known, or are known by ecosystem and name
    and so get the mark; all else stays."""
    dependency, marked = F.col("component_type") == "dependency", F.coalesce(F.col(_M)["known_ai_package"] == "true", F.lit(False))
    known = ~blank(F.col(_M)["ecosystem"]) & is_known(F.col(_M)["ecosystem"], F.col("name"))
    mark = F.map_from_entries(F.array_append(F.filter(F.map_entries(_M), lambda e: e["key"] != "known_ai_package"), F.struct(F.lit("known_ai_package").alias("key"), F.lit("true").alias("value"))))
    return c.where(~dependency | marked | known).withColumn(_M, F.when(dependency & ~marked, mark).otherwise(F.col(_M)))


def flags_in_scope(flags: DataFrame) -> DataFrame:
    """Risk flags but those of test files."""
    return flags.where(blank(F.col("file_path")) | ~is_test_path(F.col("file_path")))


def strict(c: DataFrame) -> DataFrame:
    return c.where(~F.col("needs_agentic"))


# --- after review ----------------------------------------------------------


def class_name(name: Column) -> Column:
    """A class's name rather than a model's id: a capital, then letters and
    digits with a further capital."""
    return name.rlike("^[A-Z][A-Za-z0-9]+$") & name.rlike("^.+[A-Z]")


def _failed_open(c: DataFrame, drop: Column) -> DataFrame:
    """Rows with a hint got no verdict: they always stay."""
    return c.where(~blank(F.col("agentic_hint")) | ~F.coalesce(drop, F.lit(False)))


def without_class_names(c: DataFrame) -> DataFrame:
    return _failed_open(c, (F.col("component_type") == "model") & class_name(F.col("name")))


def without_placeholders(c: DataFrame) -> DataFrame:
    """Without models and endpoints named after a variable whose value isn't known."""
    open_ = blank(F.col("model_name")) | F.col("model_name").startswith("env:")
    return _failed_open(c, F.col("component_type").isin("model", "model_endpoint", "llm_endpoint") & F.col("name").startswith("env:") & open_)


def without_unresolved_embedders(c: DataFrame, r: DataFrame) -> DataFrame:
    """Without embeddings that have neither a model nor an edge to one."""
    tied = r.where("relationship_type = 'USES_EMBEDDING'").select(F.col("source_name").alias("name"), F.lit(True).alias("_tied")).distinct()
    out = c.join(tied, "name", "left")
    bare = (F.col("component_type") == "embedding") & blank(F.col("model_name")) & blank(F.col("embedding_model")) & F.col("_tied").isNull()
    return _failed_open(out, bare).select(*c.columns)


def evidence_gate(before: DataFrame, after: DataFrame, known_models: DataFrame, verified: DataFrame) -> DataFrame:
    """Reviewed components without hard evidence go: catalogue models that no
    registry knows (``known_models``: name), memories from the catalogue that
    review left as they were, and agents found by their structure, by a change
    of type or by an import alone whose evidence isn't ``verified`` (instance_id).
    Rows that are new, or got no verdict, stay."""
    old = before.select("instance_id", F.col("component_type").alias("_type"), F.col("detection_source").alias("_source"), F.col("model_name").alias("_model"), F.to_json(F.array_sort(F.map_entries(_M))).alias("_meta"), is_import_only().alias("_import"), F.lit(True).alias("_old"))
    out = after.join(old, "instance_id", "left")
    out = out.join(known_models.select("name", F.lit(True).alias("_known")).distinct(), "name", "left").join(verified.select("instance_id", F.lit(True).alias("_ok")).distinct(), "instance_id", "left")
    t, catalogue = F.col("component_type"), F.coalesce(F.col("_source") == "kb_enrichment", F.lit(False))
    unknown = (t == "model") & catalogue & F.col("_known").isNull()
    same = (F.to_json(F.array_sort(F.map_entries(_M))).eqNullSafe(F.col("_meta"))) & F.col("model_name").eqNullSafe(F.col("_model")) & (t == F.col("_type"))
    memory = (t == "memory") & catalogue & same
    weak = F.coalesce(F.col(_M)["discovery"] == "structural_react_loop", F.lit(False)) | (t != F.col("_type")) | F.col("_import")
    agent = t.isin("agent", "agent_proxy") & weak & F.col("_ok").isNull()
    stay = F.col("_old").isNull() | ~blank(F.col("agentic_hint"))
    return out.where(stay | ~F.coalesce(unknown | memory | agent, F.lit(False))).select(*after.columns)


# --- sources ---------------------------------------------------------------


def repositories(repos: DataFrame, name: str | None = None, topic: str | None = None, archived: bool = False) -> DataFrame:
    """Repositories (name, topics, is_archived) by part of their name, by topic,
    and without archived ones."""
    out = repos if archived else repos.where(~F.coalesce(F.col("is_archived"), F.lit(False)))
    if name:
        out = out.where(F.lower("name").contains(name.lower()))
    if topic:
        out = out.where(F.exists("topics", lambda t: F.lower(t) == topic.lower()))
    return out


# --- names -----------------------------------------------------------------


def promoted_names(c: DataFrame) -> DataFrame:
    """Models and embeddings that are still named after their variable take the
    name of their model, unless that is a URL or a placeholder itself."""
    var = F.coalesce(full(F.col(_M)["env_var"]), full(F.col(_M)["env"]))
    m = F.col("model_name")
    fits = F.col("component_type").isin("model", "embedding") & (without_env_prefix(F.col("name")) == var) & ~blank(m) & (m != F.col("name")) & ~F.lower(m).rlike("^https?://") & ~m.rlike(r"\$\{[^}]+\}")
    return c.withColumn("name", F.when(F.coalesce(fits, F.lit(False)), m).otherwise(F.col("name")))


def hosted_names(c: DataFrame) -> DataFrame:
    """Models and embeddings with a hosted route's id take the base model's; the
    route stays as bedrock_model_id."""
    base = F.when(F.col("component_type").isin("model", "embedding"), bedrock_base(F.col("name")))
    model = F.when(base.isNotNull() & (F.col("model_name").isNull() | (F.col("model_name") == F.col("name"))), base).otherwise(F.col("model_name"))
    new = {"name": F.coalesce(base, "name"), "model_name": model}
    return c.select(*(new[x].alias(x) if x in new else F.col(x) for x in c.columns), F.when(base.isNotNull(), F.col("name")).alias("bedrock_model_id"))


def embeddings_apart(c: DataFrame, registry: DataFrame) -> DataFrame:
    """Models that the registry (looked up rows by model) knows as embeddings are embeddings."""
    own = registry.where(is_embedding()).select(F.col("model").alias("name"), F.lit(True).alias("_emb")).distinct()
    kind = F.when((F.col("component_type") == "model") & F.col("_emb").isNotNull(), "embedding").otherwise(F.col("component_type"))
    return c.join(own, "name", "left").withColumn("component_type", kind).select(*c.columns)


def degradations(c: DataFrame) -> DataFrame:
    """How many rows wait for review for which reason."""
    return c.where("needs_agentic").groupBy(F.coalesce(full(F.col("agentic_hint")), F.lit("unspecified")).alias("reason")).agg(F.count("*").alias("n"))
