"""Scalar functions on names, paths, URLs, images and versions, as column
expressions that stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path segments of tests; directories that scans skip.
TEST_SEGMENTS = ("tests", "test", "__tests__", "testdata", "test_data")
SKIPPED = (".git", "__pycache__", "node_modules", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", "dist", "build", ".eggs", "site-packages")
# Hosts of model providers, as patterns; words of vector stores in
# URLs; parts of configuration keys.
PROVIDER_HOSTS = (
    ("azure_openai", r"\.openai\.azure\.com"), ("openai", r"api\.openai\.com"), ("anthropic", r"api\.anthropic\.com"),
    ("aws_bedrock", r"bedrock-runtime(?:-fips)?\.[a-z0-9-]+\.amazonaws\.com"), ("google_vertex", r"[a-z0-9-]+-aiplatform\.googleapis\.com"),
    ("cohere", r"api\.cohere\.(com|ai)"), ("mistral", r"api\.mistral\.ai"), ("groq", r"api\.groq\.com"), ("together", r"api\.together\.xyz"),
    ("fireworks", r"api\.fireworks\.ai"), ("deepinfra", r"api\.deepinfra\.com"), ("perplexity", r"api\.perplexity\.ai"),
)
URL_STORES = ("weaviate", "pinecone", "qdrant", "chroma", "milvus")
EMBEDDING_KEYS = ("embedding", "embed", "vector", "retriev")
LLM_KEYS = ("chat", "completion", "llm", "gpt")
# Vector stores by what their name contains, in order.
STORE_NAMES = (("weaviate", "weaviate"), ("pinecone", "pinecone"), ("chroma", "chromadb"), ("milvus", "milvus"), ("qdrant", "qdrant"), ("faiss", "faiss"), ("pgvector", "pgvector"), ("redis", "redis"))
# What a name that stands for an environment variable begins with.
ENV_PREFIXES = ("env:", "env_model_", "env_embedding_", "dockerfile_env_")


def stripped(c: Column) -> Column:
    """Without any white space at the ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def key_of(name: Column) -> Column:
    return F.lower(stripped(name))


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))


def file_stem(path: Column) -> Column:
    """The file name without its last suffix; a leading dot begins no suffix."""
    return F.regexp_replace(F.coalesce(F.try_element_at(path_parts(path), F.lit(-1)), F.lit("")), r"(?<=.)\.[^.]+$", "")


def is_test_path(path: Column) -> Column:
    """In a directory of tests, or a file named like one.  Directories that are
    also common elsewhere (spec, testing, fixtures) never suffice."""
    stem = F.lower(file_stem(path))
    return F.coalesce(F.arrays_overlap(path_parts(path), F.array(*map(F.lit, TEST_SEGMENTS))) | stem.startswith("test_") | stem.endswith("_test"), F.lit(False))


def in_skipped_dir(path: Column) -> Column:
    """Some directory of the path, but not its file name, is never scanned."""
    dirs = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(dirs, lambda d: d.isin(*SKIPPED) | F.lower(d).rlike(r"[-_]venv$|\.egg-info$"))


def is_model_pinned(name: Column) -> Column:
    """A slash, a version, an exact or an at version, or an all-digit part of four or more."""
    c = stripped(name)
    return F.coalesce((c != "") & (c.contains("/") | c.rlike(r"\d+\.\d+|==\s*[\w.\-]+|@[\w.\-]+") | F.exists(F.split(c, "[-_:]"), lambda x: x.rlike("^[0-9]{4,}$"))), F.lit(False))


def pypi_name(name: Column) -> Column:
    return F.translate(key_of(name), "_", "-")


#: Version operators, in the order in which they are looked for.
OPERATORS = ("===", "==", ">=", "<=", "~=", "!=", ">", "<")


def requirement(line: Column) -> Column:
    """A requirement's name, version part (* without one) and pin, as a struct;
    null where the line names no package.  Extras and markers go; only an exact
    version pins."""
    base = stripped(F.regexp_replace(F.regexp_extract(stripped(line), "^([^;]*)", 1), r"\s#.*$", ""))
    sep, name, rest = F.lit(None).cast("string"), base, F.lit("")
    for op in reversed(OPERATORS):
        at = F.instr(base, F.lit(op))
        sep = F.when(at > 0, op).otherwise(sep)
        name = F.when(at > 0, F.substring(base, F.lit(1), at - 1)).otherwise(name)
        rest = F.when(at > 0, F.substring(base, at + len(op), F.lit(100_000))).otherwise(rest)
    name = F.regexp_extract(stripped(F.regexp_extract(name, r"^([^\[]*)", 1)), r"^([a-zA-Z0-9](?:[a-zA-Z0-9._-]*[a-zA-Z0-9])?)", 1)
    rest = stripped(rest)
    exact = F.when(rest.contains("=="), stripped(F.regexp_extract(rest, "^.*?===?(.*)$", 1))).when(rest.rlike(r"^[0-9][0-9a-zA-Z._\-*!]*$"), rest)
    made = F.struct(name.alias("name"), F.when(rest == "", "*").otherwise(rest).alias("spec"), F.when(sep.isin("==", "==="), exact).alias("pin"))
    return F.when((name != "") & ~stripped(line).startswith("#") & ~name.rlike(r"^[vV]?\d+(\.\d+)+[a-zA-Z0-9._-]*$"), made)


def requirement_name(spec: Column) -> Column:
    """The package of a requirement line, lower case, without extras."""
    return pypi_name(requirement(spec)["name"])


def requirement_pin(spec: Column) -> Column:
    """The version after == or ===, else null."""
    return requirement(spec)["pin"]


def full_or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def canonical_url(url: Column) -> Column:
    """http and https only; host lower case, default port, user, parameters,
    query and fragment dropped, a card's path cut off, no slash at the end but
    of the root."""
    c = stripped(url)
    scheme = F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    place = F.regexp_replace(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), "^.*@", "")
    host = F.lower(F.when(place.startswith("["), F.regexp_extract(place, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(place, "^([^:]*)", 1)))
    port = F.regexp_extract(place, r"(?:^|\])[^:\]]*:(\d+)$", 1)
    path = F.regexp_replace(F.regexp_extract(c, r"^[^:]*://[^/?#]*([^?#]*)", 1), ";[^/]*$", "")
    path = F.regexp_replace(path, r"(?i)/\.well-known/agent(-card)?\.json$", "")
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    keep = (port != "") & ~((scheme == "http") & (port == "80")) & ~((scheme == "https") & (port == "443"))
    made = F.concat(scheme, F.lit("://"), host, F.when(keep, F.concat(F.lit(":"), port)).otherwise(""), path)
    return F.when(scheme.isin("http", "https") & (host != ""), made)


def host_root(url: Column) -> Column:
    return full_or_null(F.regexp_extract(canonical_url(url), r"^(https?://[^/]+)", 1))


def canonical_git(ref: Column) -> Column:
    """host/path of a git remote in scp, URL or bare form; the host alone where
    there is no path.  Credentials, port and a trailing .git go."""
    c = stripped(ref)
    scp, url = c.rlike(r"^[^/@]+@[^:/]+:."), c.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://")
    rest = F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), "^.*@", "")
    colon = c.rlike("^[^/:]*:")
    host = F.when(scp, F.regexp_extract(c, "^[^/@]+@([^:/]+):", 1)).when(url, F.regexp_extract(rest, "^([^/]*)", 1)).when(colon, F.regexp_extract(c, "^([^:]*)", 1)).otherwise(F.regexp_extract(c, "^([^/]*)", 1))
    path = F.when(scp, F.regexp_extract(c, "^[^/@]+@[^:/]+:(.+)$", 1)).when(url, F.regexp_extract(rest, "^[^/]*/(.*)$", 1)).when(colon, F.regexp_extract(c, "^[^:]*:(.*)$", 1)).otherwise(F.regexp_extract(c, "^[^/]*/(.*)$", 1))
    host = F.lower(F.regexp_extract(host, "^([^:]*)", 1))
    path = F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), "^/+|/+$", ""), r"\.git$", "")
    return F.when(F.coalesce(ref, F.lit("")) != "", F.when(path != "", F.concat(host, F.lit("/"), path)).otherwise(host))


def canonical_image(ref: Column) -> Column:
    """registry/repository of an image without tag and digest."""
    c = F.regexp_extract(stripped(ref), "^([^@]*)", 1)
    first = F.regexp_extract(c, "^([^/]*)/", 1)
    named = first.contains(".") | first.contains(":") | (first == "localhost")
    registry = F.when(named, F.lower(first)).otherwise("docker.io")
    repo = F.when(named, F.regexp_extract(c, "^[^/]*/(.*)$", 1)).otherwise(c)
    repo = F.regexp_replace(F.translate(F.regexp_replace(repo, ":[^/:]*$", ""), "\\", "/"), "^/+|/+$", "")
    repo = F.when((registry == "docker.io") & ~repo.contains("/") & (repo != ""), F.concat(F.lit("library/"), repo)).otherwise(repo)
    return F.when(F.coalesce(ref, F.lit("")) != "", F.when(repo != "", F.concat(registry, F.lit("/"), repo)).otherwise(registry))


def canonical_source(ref: Column, kind: Column) -> Column:
    return F.when(kind == "container_image", canonical_image(ref)).otherwise(canonical_git(ref))


def key_tokens(key: Column) -> Column:
    return F.filter(F.split(F.lower(key), "[._-]+"), lambda x: x != "")


def _holds(c: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(c).rlike("|".join(words)), F.lit(False))


def classify_endpoint(url: Column, key: Column | None = None, paired: Column | None = None) -> Column:
    """Vector store by the URL, endpoint of a language model by the provider's
    host, else by the kind (embedding, llm) of the model it is paired with, else
    by the key, else a model endpoint."""
    key, paired = (F.lit(None).cast("string") if x is None else x for x in (key, paired))
    hosted = _holds(url, tuple(p for _, p in PROVIDER_HOSTS))
    return (F.when(_holds(url, URL_STORES), "vector_store").when(hosted, "llm_endpoint")
            .when(paired == "embedding", "model_endpoint").when(paired == "llm", "llm_endpoint")
            .when(_holds(key, EMBEDDING_KEYS), "model_endpoint").when(_holds(key, LLM_KEYS), "llm_endpoint").otherwise("model_endpoint"))


def vector_store_technology(component_type: Column, metadata: Column, name: Column, model_name: Column) -> Column:
    """What a vector store runs on: as noted, else by its name; null for others."""
    held = F.lower(F.coalesce(full_or_null(model_name), name, F.lit("")))
    by_name = F.lit(None).cast("string")
    for part, technology in reversed(STORE_NAMES):
        by_name = F.when(held.contains(part), technology).otherwise(by_name)
    return F.when(component_type == "vector_store", F.coalesce(full_or_null(F.lower(stripped(metadata["store_technology"]))), by_name))


def without_env_prefix(name: Column) -> Column:
    """A name without what marks it as an environment variable's."""
    out = name
    for prefix in reversed(ENV_PREFIXES):
        out = F.when(name.startswith(prefix), F.substring(name, len(prefix) + 1, 100_000)).otherwise(out)
    return out


# Transports that a server may name itself.
TRANSPORTS = ("stdio", "sse", "streamable-http", "streamable_http")


def transport(explicit: Column, url: Column) -> Column:
    """A known transport as stated, else by the URL, else standard input and output."""
    said = F.lower(stripped(explicit))
    by_url = F.when(F.coalesce(url, F.lit("")) == "", "stdio").when(F.lower(url).contains("streamable"), "streamable-http").otherwise("sse")
    return F.when(said.isin(*TRANSPORTS), F.translate(said, "_", "-")).otherwise(by_url)


def class_segment(dotted: Column) -> Column:
    """The rightmost segment of a dotted name that begins with a capital."""
    return F.when(dotted.contains("."), F.try_element_at(F.filter(F.reverse(F.split(dotted, r"\.")), lambda x: x.rlike(r"^\p{Lu}")), F.lit(1)))


def framework_family(c: Column) -> Column:
    """What stands before the first underscore, and of that before the first hyphen."""
    return F.split_part(F.split_part(c, F.lit("_"), F.lit(1)), F.lit("-"), F.lit(1))


def frameworks_related(a: Column, b: Column) -> Column:
    """Of one family; a blank is related to all."""
    return (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "") | (a == b) | (framework_family(a) == framework_family(b))


def resolved_chain(name: Column, variables: Column) -> Column:
    """``var.method`` with the variable's class for the variable (a map by
    name), unless the name is that class's or below it already."""
    head = F.regexp_extract(name, r"^([^.]*)\.", 1)
    target = variables[head]
    done = (name == target) | name.startswith(F.concat(target, F.lit(".")))
    return F.when(name.contains(".") & (F.coalesce(target, F.lit("")) != "") & ~done, F.concat(target, F.lit("."), F.regexp_extract(name, r"^[^.]*\.(.*)$", 1))).otherwise(name)


def component_identity(component_type: Column, name: Column, repository: Column, path: Column, line: Column) -> Column:
    """What makes two reports' rows the same asset, as JSON: names without
    differences of case and white space, paths without dot segments."""
    token = lambda c: F.lower(F.regexp_replace(stripped(F.coalesce(c, F.lit(""))), r"\s+", " "))
    return F.to_json(F.struct(token(component_type).alias("component_type"), F.coalesce(line, F.lit(0)).alias("line"), token(name).alias("name"), normal_path(path).alias("path"), F.coalesce(repository, F.lit("")).alias("repository")))


def normal_path(path: Column) -> Column:
    """A path with / and without empty, . and (where a directory stands before) .. segments."""
    parts = F.filter(F.split(F.translate(stripped(F.coalesce(path, F.lit(""))), "\\", "/"), "/"), lambda x: ~x.isin("", "."))
    step = lambda held, x: F.when((x == "..") & (F.size(held) > 0) & (F.try_element_at(held, F.lit(-1)) != ".."), F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(F.array_append(held, x))
    rooted = F.translate(stripped(F.coalesce(path, F.lit(""))), "\\", "/").startswith("/")
    return F.concat(F.when(rooted, "/").otherwise(""), F.concat_ws("/", F.aggregate(parts, F.array().cast("array<string>"), step)))


# Fixed value: routes of hosted models: a region, the provider, the base id, a version.
BEDROCK = r"(?i)^((?:us|us-gov|eu|apac|ap|ca|jp|au|global)\.)?(?:anthropic|amazon|meta|mistral|cohere|ai21|deepseek|writer|qwen|openai)\.([a-z0-9][a-z0-9.\-]*?)(-v\d+(?::\d+)?)?$"


def bedrock_base(model: Column) -> Column:
    """The base id of a hosted model's id that has a region or a version and a
    digit in its base; else null."""
    c = stripped(model)
    region, base, version = (F.regexp_extract(c, BEDROCK, i) for i in (1, 2, 3))
    return F.when(((region != "") | (version != "")) & base.rlike("[0-9]"), base)


def model_aliases(model: Column) -> Column:
    """Names under which a registry may hold the model, the most exact first."""
    low = F.lower(model)
    tail = F.regexp_replace(low, "^.*/", "")
    bare = F.regexp_replace(tail, "^ft:", "")
    parts = F.split(bare, r"\.")
    n = F.size(parts)
    dotted = F.when(n > 1, F.filter(F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: F.concat_ws(".", F.slice(parts, i, n))), lambda x: x != "")).otherwise(F.array().cast("array<string>"))
    plain = F.regexp_replace(F.element_at(parts, -1), ":[0-9]+$", "")
    undated = F.regexp_replace(plain, r"-\d{4}-?\d{2}-?\d{2}(-v\d+)?$", "")
    # A name of dots alone has no alias but itself.
    return F.array_distinct(F.filter(F.concat(F.array(low, tail, bare), dotted, F.array(plain, F.when(F.length(undated) >= 3, undated).otherwise(plain))), lambda x: (x != "") | (low == "")))


# Strings that name no model.
NO_MODELS = ("", "true", "false", "null", "none", "auto", "default")


def plausible_model(value: Column) -> Column:
    """What can be a model's id: 2 to 256 characters with a letter, without
    white space, no placeholder and no word that says nothing."""
    low = F.lower(value)
    return F.coalesce(F.length(value).between(2, 256) & ~low.isin(*NO_MODELS) & ~low.startswith("${") & ~value.rlike(r"\s") & value.rlike("[a-zA-Z]"), F.lit(False))


def inline_annotation(line: Column, marker: str = "asset") -> Column:
    """What a comment ``# marker: key=value ...`` says, as a map by lower-case
    key (the last of a key counts); null without a concept."""
    body = F.regexp_extract(line, rf"#\s*{marker}:\s*(.+)", 1)
    pairs = F.regexp_extract_all(body, F.lit(r"\w+=\S+"), F.lit(0))
    keys = F.transform(pairs, lambda p: F.lower(F.regexp_extract(p, r"^(\w+)=", 1)))
    value = lambda k, p: F.when(k == "concept", F.lower(F.regexp_replace(p, r"^\w+=", ""))).otherwise(F.regexp_replace(p, r"^\w+=", ""))
    entries = F.transform(pairs, lambda p, i: F.struct(F.element_at(keys, i + 1).alias("key"), value(F.element_at(keys, i + 1), p).alias("value"), i.alias("i")))
    last = F.filter(entries, lambda e: ~F.exists(F.slice(keys, e["i"] + 2, F.greatest(F.size(keys), F.lit(1))), lambda k: k == e["key"]))
    return F.when(F.array_contains(keys, "concept"), F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"]))))


def utc_stamp(c: Column) -> Column:
    """A timestamp in ISO-8601 with Z."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def short_hash(c: Column, n: int) -> Column:
    return F.substring(F.sha2(c, 256), 1, n)


def ancestors(path: Column) -> Column:
    """Directories above a path, the nearest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda i: F.concat_ws("/", F.slice(parts, 1, i)))
