"""The model registry: what a model's id says of its provider and family.

A table of models from outside (rows model, provider, mode, deprecated, ord) is
spread to all names under which each can be found; what it lacks is looked up in
a table of patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inventra.functions.text import model_aliases, stripped

# Patterns of model ids with provider and family, the first match counts;
# families of which some are retired.
PATTERNS = (
    (r"^gpt-4o-\d{4}-\d{2}-\d{2}$", "openai", "gpt-4o"), (r"^gpt-4-\d{4}-\d{2}-\d{2}$", "openai", "gpt-4"), (r"^gpt-3\.5-turbo-\d{4}-\d{2}-\d{2}$", "openai", "gpt-3.5-turbo"),
    (r"^gpt-4o-mini$", "openai", "gpt-4o"), (r"^gpt-4o$", "openai", "gpt-4o"), (r"^gpt-4-turbo$", "openai", "gpt-4"), (r"^gpt-4$", "openai", "gpt-4"), (r"^gpt-4-32k", "openai", "gpt-4"),
    (r"^gpt-4\.1$", "openai", "gpt-4.1"), (r"^gpt-4\.1-mini$", "openai", "gpt-4.1"), (r"^gpt-4\.1-nano$", "openai", "gpt-4.1"), (r"^gpt-4\.5", "openai", "gpt-4.5"),
    (r"^gpt-3\.5-turbo$", "openai", "gpt-3.5"), (r"^o1-preview(-\d{4}-\d{2}-\d{2})?$", "openai", "o1"), (r"^o1-pro$", "openai", "o1"), (r"^o1-mini$", "openai", "o1"), (r"^o1$", "openai", "o1"),
    (r"^o3-mini$", "openai", "o3"), (r"^o3$", "openai", "o3"), (r"^o4-mini$", "openai", "o4"), (r"^text-embedding-ada-002$", "openai", "embedding"), (r"^text-embedding-3-(small|large)$", "openai", "embedding"),
    (r"^claude-3-5-sonnet-\d{8}$", "anthropic", "claude-3-5-sonnet"), (r"^claude-3-5-haiku-\d{8}$", "anthropic", "claude-3-5-haiku"), (r"^claude-3-7-sonnet-\d{8}$", "anthropic", "claude-3-7-sonnet"),
    (r"^claude-3-opus-\d{8}$", "anthropic", "claude-3-opus"), (r"^claude-3-sonnet-\d{8}$", "anthropic", "claude-3-sonnet"), (r"^claude-3-haiku-\d{8}$", "anthropic", "claude-3-haiku"),
    (r"^claude-4-sonnet-\d{8}$", "anthropic", "claude-4-sonnet"), (r"^claude-4-opus-\d{8}$", "anthropic", "claude-4-opus"), (r"^claude-sonnet-4-\d{8}$", "anthropic", "claude-sonnet-4"),
    (r"^claude-opus-4-\d{8}$", "anthropic", "claude-opus-4"), (r"^claude-haiku-4-\d{8}$", "anthropic", "claude-haiku-4"), (r"^claude-3-5-sonnet$", "anthropic", "claude-3-5-sonnet"),
    (r"^claude-3-5-haiku$", "anthropic", "claude-3-5-haiku"), (r"^claude-3-7-sonnet$", "anthropic", "claude-3-7-sonnet"), (r"^claude-3-opus$", "anthropic", "claude-3-opus"),
    (r"^claude-3-sonnet$", "anthropic", "claude-3-sonnet"), (r"^claude-3-haiku$", "anthropic", "claude-3-haiku"), (r"^claude-4-sonnet$", "anthropic", "claude-4-sonnet"), (r"^claude-4-opus$", "anthropic", "claude-4-opus"),
    (r"^claude-sonnet-4(?:-\d+)?$", "anthropic", "claude-sonnet-4"), (r"^claude-opus-4(?:-\d+)?$", "anthropic", "claude-opus-4"), (r"^claude-haiku-4(?:-\d+)?$", "anthropic", "claude-haiku-4"),
    (r"^gemini-2\.5-pro$", "google", "gemini-2.5"), (r"^gemini-2\.0-flash$", "google", "gemini-2.0"), (r"^gemini-1\.5-flash$", "google", "gemini-1.5"), (r"^gemini-1\.5-pro$", "google", "gemini-1.5"),
    (r"^llama[-_]4", "meta", "llama-4"), (r"^llama[-_]3\.3", "meta", "llama-3.3"), (r"^llama[-_]3\.2", "meta", "llama-3.2"), (r"^llama[-_]3\.1", "meta", "llama-3.1"), (r"^llama[-_]3\b", "meta", "llama-3"), (r"^llama[-_]2\b", "meta", "llama-2"),
    (r"^llama4\b", "meta", "llama-4"), (r"^llama3-3\b", "meta", "llama-3.3"), (r"^llama3-2\b", "meta", "llama-3.2"), (r"^llama3-1\b", "meta", "llama-3.1"), (r"^llama3\b", "meta", "llama-3"), (r"^llama2\b", "meta", "llama-2"),
    (r"^mistral-7b", "mistral", "mistral-7b"), (r"^mistral-large", "mistral", "mistral-large"), (r"^mistral-medium", "mistral", "mistral-medium"), (r"^mistral-small", "mistral", "mistral-small"), (r"^mixtral", "mistral", "mixtral"), (r"^codestral", "mistral", "codestral"), (r"^pixtral", "mistral", "pixtral"),
    (r"^phi-4\b", "microsoft", "phi-4"), (r"^phi-3\b", "microsoft", "phi-3"), (r"^qwen2\.5", "qwen", "qwen2.5"), (r"^qwen2\b", "qwen", "qwen2"), (r"^qwen\b", "qwen", "qwen"),
    (r"^deepseek-r1", "deepseek", "deepseek-r1"), (r"^deepseek-v3", "deepseek", "deepseek-v3"), (r"^deepseek-v2", "deepseek", "deepseek-v2"),
    (r"^command-r-plus(?:-v\d+)?$", "cohere", "command-r-plus"), (r"^command-r(?:-v\d+)?$", "cohere", "command-r"), (r"^command-light(?:-text)?(?:-v\d+)?$", "cohere", "command-light"), (r"^command(?:-text)?(?:-v\d+)?$", "cohere", "command"),
    (r"^embed-english(?:-light)?(?:-v\d+)?$", "cohere", "embed-english"), (r"^embed-multilingual(?:-light)?(?:-v\d+)?$", "cohere", "embed-multilingual"),
    (r"^nova-pro(?:-v\d+)?$", "amazon", "nova-pro"), (r"^nova-lite(?:-v\d+)?$", "amazon", "nova-lite"), (r"^nova-micro(?:-v\d+)?$", "amazon", "nova-micro"), (r"^nova-canvas(?:-v\d+)?$", "amazon", "nova-canvas"), (r"^nova-reel(?:-v\d+)?$", "amazon", "nova-reel"), (r"^nova-sonic(?:-v\d+)?$", "amazon", "nova-sonic"),
    (r"^titan-text-(?:express|lite|premier|agile)(?:-v\d+)?$", "amazon", "titan-text"), (r"^titan-embed-text(?:-v\d+)?$", "amazon", "titan-embed-text"), (r"^titan-embed-image(?:-v\d+)?$", "amazon", "titan-embed-image"), (r"^titan-image-generator(?:-v\d+)?$", "amazon", "titan-image-generator"),
)
RETIRED = (r"^gpt-4-32k", r"^o1-preview(-\d{4}-\d{2}-\d{2})?$", r"^text-embedding-ada-002$")
# Providers that serve their own models; other names of providers.
NATIVE = ("openai", "anthropic", "google", "gemini", "mistral", "cohere", "deepseek", "xai", "perplexity", "groq", "fireworks_ai", "together_ai", "ollama", "huggingface", "replicate", "ai21", "writer", "voyage")
PROVIDER_NAMES = {"gemini": "google", "bedrock_converse": "bedrock", "bedrock/invoke": "bedrock"}
VERTEX = ("anthropic_models", "gemini_models", "ai21_models", "code-chat-models", "chat-models", "code-text-models", "text-models", "language-models", "image-models", "embedding-models", "mistral_models", "llama_models")


def canonical_provider(provider: Column) -> Column:
    low = F.lower(provider)
    out = F.when(low.isin(*(f"vertex_ai-{x}" for x in VERTEX)), "vertex_ai").otherwise(low)
    for name, canonical in PROVIDER_NAMES.items():
        out = F.when(low == name, canonical).otherwise(out)
    return out


def by_pattern(name: Column) -> Column:
    """provider, family and deprecated of the first pattern that matches; else null."""
    low = F.lower(name)
    none = F.lit(None).cast("struct<provider:string,family:string,deprecated:boolean>")
    out = none
    for pattern, provider, family in reversed(PATTERNS):
        out = F.when(low.rlike(pattern), F.struct(F.lit(provider).alias("provider"), F.lit(family).alias("family"), F.lit(pattern in RETIRED).alias("deprecated"))).otherwise(out)
    # Most names are no model's: one test of all patterns at once stands before.
    return F.when(low.rlike("^(?:" + "|".join(pattern.removeprefix("^") for pattern, _, _ in PATTERNS) + ")"), out).otherwise(none)


def built_in(key: Column) -> Column:
    """What the patterns say of a name, or else of its aliases unless it is a path's."""
    slug = key.rlike(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$")
    alias = F.try_element_at(F.filter(F.transform(model_aliases(key), by_pattern), lambda x: x.isNotNull()), F.lit(1))
    return F.coalesce(by_pattern(key), F.when(~slug, alias))


def no_model(name: Column) -> Column:
    """Versions, plain numbers and addresses are never models."""
    return name.rlike(r"(?i)^v?\d+(\.\d+)+([a-z]\d*)?(-[a-z0-9.+]+)?$") | name.rlike(r"^\d+(\.\d+)?$") | name.rlike(r"^(\d{1,3}\.){3}\d{1,3}$")


def spread(models: DataFrame) -> DataFrame:
    """alias, provider, family, mode, deprecated of a table of models: exact names
    before other aliases, and of each native providers before gateways; the
    first in ``ord`` on ties."""
    provider = canonical_provider(F.coalesce("provider", F.when(F.col("model").contains("/"), F.split_part("model", F.lit("/"), F.lit(1))).otherwise("unknown")))
    own = models.where(F.coalesce("model", F.lit("")) != "").select(F.lower("model").alias("low"), provider.alias("provider"), F.lower(F.coalesce("mode", F.lit(""))).alias("mode"), F.coalesce("deprecated", F.lit(False)).alias("deprecated"), "ord", model_aliases(F.col("model")).alias("aliases"))
    canonical = F.element_at("aliases", -1)
    family = F.when(canonical.contains("-"), F.regexp_replace(canonical, "-[^-]*$", "")).otherwise(canonical)
    each = own.select("low", "provider", "mode", "deprecated", "ord", family.alias("family"), F.explode("aliases").alias("alias"))
    rank = F.struct((F.col("alias") != F.col("low")).alias("other"), (~F.col("provider").isin(*NATIVE)).alias("gateway"), "ord")
    best = each.groupBy("alias").agg(F.min_by(F.struct("provider", "family", "mode", "deprecated"), rank).alias("m"))
    return best.select("alias", "m.*")


def lookup(names: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """``names`` (a column model) with provider, family, mode, deprecated and
    source (model_catalog, builtin, or null for what isn't known).  A gateway's
    row gives way to a native pattern that matches the very name."""
    key = stripped(F.coalesce("model", F.lit("")))
    fits = (key != "") & ~no_model(key)
    if models is None:
        # A function of the name alone: no join.
        m = F.when(fits, built_in(key))
        told = names.withColumn("_built", m)
        source = F.when(F.col("_built").isNotNull(), "builtin")
        return told.select(*names.columns, "_built.provider", "_built.family", F.lit(None).cast("string").alias("mode"), "_built.deprecated", source.alias("source"))
    own = names.select("model").distinct().withColumn("key", key).where(fits).withColumn("aliases", model_aliases(F.col("key")))
    each = own.select("model", F.posexplode("aliases").alias("rank", "alias"))
    found = each.join(spread(models), "alias").groupBy("model").agg(F.min_by(F.struct("provider", "family", "mode", "deprecated"), "rank").alias("live"))
    own = own.join(found, "model", "left").withColumn("direct", by_pattern(F.col("key")))
    hit, built = F.col("live"), built_in(F.col("key"))
    gateway = hit.isNotNull() & ~hit["provider"].isin(*NATIVE) & F.coalesce(F.col("direct.provider").isin(*NATIVE), F.lit(False))
    live = hit.isNotNull() & ~gateway
    made = F.struct(
        F.when(live, hit["provider"]).otherwise(built["provider"]).alias("provider"), F.when(live, hit["family"]).otherwise(built["family"]).alias("family"),
        F.when(live, hit["mode"]).alias("mode"), F.when(live, hit["deprecated"]).otherwise(built["deprecated"]).alias("deprecated"),
        F.when(live, "model_catalog").when(built.isNotNull(), "builtin").alias("source"))
    known = own.select("model", made.alias("m")).where("m.source is not null").select("model", "m.*")
    return names.join(known, "model", "left")


def kind(provider_row: Column | None = None) -> Column:
    """embedding or llm, of a row that was looked up; null for what isn't known."""
    family, mode = F.lower(F.coalesce("family", F.lit(""))), F.coalesce("mode", F.lit(""))
    return F.when(F.col("source").isNull(), None).when((mode == "embedding") | family.contains("embed"), "embedding").otherwise("llm")


def is_embedding() -> Column:
    """Of a row that was looked up: the registry knows it as an embedding model."""
    return F.coalesce((F.col("mode") == "embedding") | F.lower("family").startswith("embed"), F.lit(False))
