"""Queries of names: models, packages, classes, annotations and identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from inventra.catalogue import _t, query
from inventra.functions import registry
from inventra.functions import text as X
from inventra.functions.packages import is_known
from inventra.operators import joins, scope


def _picked(key, values):
    """One of ``values`` by the remainder of a key; None is null."""
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (key % len(values) + 1).cast("int"))


def _sql(values) -> str:
    """The values as a DuckDB list."""
    one = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "[" + ", ".join(map(one, values)) + "]"


_ALIASES = (
    ("Azure/eu/GPT-4o-2024-08-06", "azure/eu/gpt-4o-2024-08-06|gpt-4o-2024-08-06|gpt-4o"),
    ("us.anthropic.claude-3-5-sonnet-20241022-v2:0", "us.anthropic.claude-3-5-sonnet-20241022-v2:0|anthropic.claude-3-5-sonnet-20241022-v2:0|claude-3-5-sonnet-20241022-v2:0|claude-3-5-sonnet-20241022-v2|claude-3-5-sonnet"),
    ("ft:gpt-4o:7", "ft:gpt-4o:7|gpt-4o:7|gpt-4o"), ("plain", "plain"), ("a.b", "a.b|b"), ("x-2024-01-01", "x-2024-01-01"), ("org/ft:m-20240101", "org/ft:m-20240101|ft:m-20240101|m-20240101"),
)


@query(f"select p_partkey, {_sql([a for _, a in _ALIASES])}[p_partkey % {len(_ALIASES)} + 1] as aliases from part")
def model_alias_keys(spark, d):
    m = _picked(F.col("p_partkey"), [x for x, _ in _ALIASES])
    return _t(spark, d, "part").select("p_partkey", F.concat_ws("|", X.model_aliases(m)).alias("aliases"))


_ROUTES = (
    ("us.anthropic.claude-3-5-haiku-20241022-v1:0", "claude-3-5-haiku-20241022"), ("anthropic.claude-3-haiku", None), ("meta.llama3-70b-instruct-v1:0", "llama3-70b-instruct"),
    ("EU.Amazon.nova-2", "nova-2"), ("openai.gpt-v1", None), ("gpt-4o", None), ("us-gov.cohere.embed-v3", None), ("apac.deepseek.r1", "r1"),
)


@query(f"""with r as (select p_partkey, {_sql([x for x, _ in _ROUTES])}[p_partkey % 8 + 1] as name, {_sql([y for _, y in _ROUTES])}[p_partkey % 8 + 1] as base, p_partkey % 3 as k from part)
select p_partkey, case when k < 2 then coalesce(base, name) else name end as name, case when k < 2 and base is not null then case when k = 0 then base else 'own' end when k = 0 then null else 'own' end as model_name, case when k < 2 and base is not null then name end as bedrock_model_id from r""")
def bedrock_ids(spark, d):
    k = F.col("p_partkey")
    c = _t(spark, d, "part").select("p_partkey", _picked(k, [x for x, _ in _ROUTES]).alias("name"), F.when(k % 3 == 0, "model").when(k % 3 == 1, "embedding").otherwise("tool").alias("component_type"), F.when(k % 3 > 0, "own").alias("model_name"))
    return scope.hosted_names(c).select("p_partkey", "name", "model_name", "bedrock_model_id")


_LINES = (
    ("openai==1.2.3", "openai", "1.2.3", "1.2.3"), ("LangChain_Core[all]>=0.1 ; x", "LangChain_Core", "0.1", None), ("flask", "flask", "*", None), ("# c", None, None, None), ("a === 1.0", "a", "1.0", "1.0"),
    ("b ~= 2", "b", "2", None), ("c==1,<2", "c", "1,<2", None), ("1.2.3", None, None, None), ("", None, None, None), ("d-", "d", "*", None), ("e<3,==2", "e", "2", "2"), ("f!=1", "f", "1", None),
)


@query(f"select p_partkey, {_sql([n for _, n, _, _ in _LINES])}[p_partkey % 12 + 1] as name, {_sql([s for _, _, s, _ in _LINES])}[p_partkey % 12 + 1] as spec, {_sql([v for *_, v in _LINES])}[p_partkey % 12 + 1] as pin from part")
def requirement_parts(spark, d):
    r = X.requirement(_picked(F.col("p_partkey"), [x for x, *_ in _LINES]))
    return _t(spark, d, "part").select("p_partkey", r.alias("r")).select("p_partkey", "r.name", "r.spec", "r.pin")


_PACKAGES = (("pypi", "LangChain_Core", True), ("pypi", "flask", False), ("npm", "@langchain/core", True), ("npm", "OpenAI", False), ("go", "github.com/tmc/langchaingo/llms", True), ("go", "github.com/tmc/langchaingo2", False), ("maven", "dev.langchain4j:x", True), ("maven", "dev.langchain4j.y:z", True), ("maven", "com.azure:azure-ai-openai", True), ("maven", "dev.langchain4jx:a", False), ("nuget", "openai", False), ("cargo", "burn", True), ("rubygems", "langchainrb", True))


@query(f"""with p as (select p_partkey, {_sql([e for e, _, _ in _PACKAGES])}[p_partkey % 13 + 1] as e, {_sql([n for _, n, _ in _PACKAGES])}[p_partkey % 13 + 1] as n, {_sql([k for *_, k in _PACKAGES])}[p_partkey % 13 + 1] as k, p_partkey % 4 = 0 as marked, p_partkey % 3 = 0 as other from part)
select p_partkey, n as name, case when other then null else 'true' end as mark from p where other or marked or k""")
def known_packages(spark, d):
    k = F.col("p_partkey")
    eco, name = _picked(k, [e for e, _, _ in _PACKAGES]), _picked(k, [n for _, n, _ in _PACKAGES])
    md = F.when(k % 3 == 0, F.create_map(F.lit("ecosystem"), eco)).when(k % 4 == 0, F.create_map(F.lit("ecosystem"), eco, F.lit("known_ai_package"), F.lit("true"))).otherwise(F.create_map(F.lit("ecosystem"), eco, F.lit("known_ai_package"), F.lit("false")))
    c = _t(spark, d, "part").select("p_partkey", name.alias("name"), F.when(k % 3 == 0, "tool").otherwise("dependency").alias("component_type"), md.alias("metadata"))
    return scope.known_dependencies_only(c).select("p_partkey", "name", F.col("metadata")["known_ai_package"].alias("mark"))


_DOTTED = (("pkg.FAISS.from_texts", "FAISS", "pkg.FAISS.from_texts"), ("openai.OpenAI.chat.create", "OpenAI", "openai.OpenAI.chat.create"), ("Agent", None, "Agent"), ("a.b", None, "a.b"), ("llm.invoke", None, "langchain_openai.ChatOpenAI.invoke"), ("mcp.server.FastMCP.run", "FastMCP", "mcp.server.FastMCP.run"), ("x.Ägent", "Ägent", "x.Ägent"))


@query(f"select p_partkey, {_sql([c for _, c, _ in _DOTTED])}[p_partkey % 7 + 1] as segment, {_sql([r for *_, r in _DOTTED])}[p_partkey % 7 + 1] as chain, p_partkey % 5 in (0, 1, 3) as related from part")
def class_segments(spark, d):
    k = F.col("p_partkey")
    name = _picked(k, [n for n, _, _ in _DOTTED])
    variables = F.create_map(*map(F.lit, ("llm", "langchain_openai.ChatOpenAI", "mcp", "mcp.server.FastMCP", "a", "")))
    related = X.frameworks_related(_picked(k, ["langchain_openai", "", "openai", "crewai-tools", "a"]), _picked(k, ["langchain-community", "x", "langchain", "crewai", "b"]))
    return _t(spark, d, "part").select("p_partkey", X.class_segment(name).alias("segment"), X.resolved_chain(name, variables).alias("chain"), related.alias("related"))


_SERVERS = ((" SSE ", "", "sse"), ("streamable_http", None, "streamable-http"), ("odd", "https://h/Streamable", "streamable-http"), (None, "https://h", "sse"), ("", "", "stdio"), (None, None, "stdio"), ("stdio", "https://h", "stdio"))


@query(f"select p_partkey, {_sql([t for *_, t in _SERVERS])}[p_partkey % 7 + 1] as transport from part")
def transports(spark, d):
    k = F.col("p_partkey")
    return _t(spark, d, "part").select("p_partkey", X.transport(_picked(k, [e for e, _, _ in _SERVERS]), _picked(k, [u for _, u, _ in _SERVERS])).alias("transport"))


_NOTES = (("x = 1  # asset: Concept=Model framework=a label=b", "concept=model,framework=a,label=b"), ("# asset: framework=a", None), ("# asset: concept=a concept=B", "concept=b"), ("y", None), ("#asset:  concept=x z='q w'", "concept=x,z='q"))


@query(f"select p_partkey, {_sql([w for _, w in _NOTES])}[p_partkey % 5 + 1] as annotation from part")
def inline_annotations(spark, d):
    held = X.inline_annotation(_picked(F.col("p_partkey"), [n for n, _ in _NOTES]))
    said = F.concat_ws(",", F.transform(F.array_sort(F.map_entries(held)), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return _t(spark, d, "part").select("p_partkey", F.when(held.isNotNull(), said).alias("annotation"))


_PLACES = ((" GPT  4o", "./a//b/../c.py", "gpt 4o", "a/c.py"), ("x\ty", "/r/./z", "x y", "/r/z"), ("N", "a\\b", "n", "a/b"), ("q", "../../p", "q", "../../p"), ("w", "", "w", ""))


@query(f"""select p_partkey, '{{"component_type":"' || lower(p_type) || '","line":' || p_size || ',"name":"' || {_sql([n for *_, n, _ in _PLACES])}[p_partkey % 5 + 1] || '","path":"' || {_sql([p for *_, p in _PLACES])}[p_partkey % 5 + 1] || '","repository":"r"}}' as identity from part""")
def asset_identities(spark, d):
    k = F.col("p_partkey")
    return _t(spark, d, "part").select("p_partkey", X.component_identity(F.col("p_type"), _picked(k, [n for n, *_ in _PLACES]), F.lit("r"), _picked(k, [p for _, p, *_ in _PLACES]), F.col("p_size")).alias("identity"))


_IDS = ("gpt-4o", "a", "", "None", "${X}", "two words", "12345", "org/m", "x" * 257, "auto", "m1", None)


@query(f"select p_partkey, {_sql([True, False, False, False, False, False, False, True, False, False, True, False])}[p_partkey % 12 + 1] as plausible from part")
def plausible_models(spark, d):
    return _t(spark, d, "part").select("p_partkey", X.plausible_model(_picked(F.col("p_partkey"), _IDS)).alias("plausible"))


_VARS = (("env:LLM", "LLM", "gpt-4o", "gpt-4o"), ("env_model_LLM", "LLM", "https://x", "env_model_LLM"), ("dockerfile_env_A", "A", "${B}", "dockerfile_env_A"), ("LLM", "LLM", "m-1", "m-1"), ("other", "LLM", "m-1", "other"), ("env_embedding_E", "E", "", "env_embedding_E"), ("env:Z", None, "m", "env:Z"))


@query(f"select p_partkey, case when p_partkey % 2 = 0 then {_sql([w for *_, w in _VARS])}[p_partkey % 7 + 1] else {_sql([n for n, *_ in _VARS])}[p_partkey % 7 + 1] end as name from part")
def promoted_env_names(spark, d):
    k = F.col("p_partkey")
    c = _t(spark, d, "part").select("p_partkey", _picked(k, [n for n, *_ in _VARS]).alias("name"), F.when(k % 2 == 0, "model").otherwise("tool").alias("component_type"), _picked(k, [m for _, _, m, _ in _VARS]).alias("model_name"), F.create_map(F.lit("env"), _picked(k, [v for _, v, *_ in _VARS])).alias("metadata"))
    return scope.promoted_names(c).select("p_partkey", "name")


_ASKED = ("gpt-4o-2024-08-06", "us.anthropic.claude-3-7-sonnet-20250219-v1:0", "meta-llama/Llama-3.1-8B", "3.10.2", "text-embedding-3-small", "10.0.0.1", "claude-3-5-sonnet", "custom-x", "llama3-1-8b", "o1-preview", "vendor/own-embed")
_TOLD = (("openai", "gpt-4o"), ("anthropic", "claude-3-7-sonnet"), (None, None), (None, None), ("openai", "embedding"), (None, None), ("anthropic", "claude-3-5-sonnet"), ("acme", "custom"), ("meta", "llama-3.1"), ("openai", "o1"), ("vendor", "own"))


@query(f"""with r as (select p_partkey, p_partkey % 11 + 1 as i from part) select p_partkey, {_sql([p for p, _ in _TOLD])}[i] as provider, {_sql([f for _, f in _TOLD])}[i] as family, case when i in (8, 11) then 'model_catalog' when {_sql([p for p, _ in _TOLD])}[i] is not null then 'builtin' end as source, case when i = 10 then true when {_sql([p for p, _ in _TOLD])}[i] is not null then false end as deprecated, case when i = 11 then 'embedding' when i = 5 then 'embedding' when {_sql([p for p, _ in _TOLD])}[i] is not null then 'llm' end as kind from r""")
def registry_lookup(spark, d):
    names = _t(spark, d, "part").select("p_partkey", _picked(F.col("p_partkey"), _ASKED).alias("model"))
    models = spark.createDataFrame([("bedrock/claude-3-5-sonnet", "bedrock", "chat", False, 1), ("custom-x", "acme", "chat", False, 2), ("vendor/own-embed", None, "embedding", False, 3)], "model string, provider string, mode string, deprecated boolean, ord int")
    out = registry.lookup(names, models)
    return out.select("p_partkey", "provider", "family", "source", "deprecated", registry.kind().alias("kind"))


@query("""select distinct p_brand || '.tools_' || p_size || '.' || replace(p_type, ' ', '_') as id from part where p_size % 10 = 1 and p_partkey % 2 = 0""")
def catalogue_paths(spark, d):
    p = _t(spark, d, "part")
    k = p.select(F.concat("p_brand", F.lit(".tools_"), F.col("p_size").cast("string"), F.lit("."), F.translate("p_type", " ", "_")).alias("id"), F.when(F.col("p_partkey") % 2 == 0, "Tool").otherwise("agent").alias("concept"), F.when(F.col("p_size") == 0, "parameter").alias("label"))
    return joins.ids_by_path(k.where(F.col("id").rlike(r"tools_\d*1\.")), ".tool__", ["TOOL", "x"])


@query("""select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as stamp from events""")
def utc_stamps(spark, d):
    return _t(spark, d, "events").select("event_id", X.utc_stamp(F.col("ts")).alias("stamp"))


@query("""select s_suppkey, case when s_suppkey % 4 = 0 then 'qdrant' when s_suppkey % 5 = 0 then 'chromadb' when s_suppkey % 5 = 1 then 'redis' end as technology from supplier where s_suppkey % 3 = 0 union all select s_suppkey, null from supplier where s_suppkey % 3 <> 0""")
def store_technology(spark, d):
    k = F.col("s_suppkey")
    md = F.when(k % 4 == 0, F.create_map(F.lit("store_technology"), F.lit(" Qdrant ")))
    name = F.when(k % 5 == 0, "MyChroma_x").when(k % 5 == 1, "my-Redis").otherwise("index")
    return _t(spark, d, "supplier").select("s_suppkey", X.vector_store_technology(F.when(k % 3 == 0, "vector_store").otherwise("tool"), md, name, F.lit("")).alias("technology"))
