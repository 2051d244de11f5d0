"""Assets of infrastructure files: Kubernetes, Helm, CloudFormation, ARM, Terraform
and Bicep.

One pass writes each document's *leaves*, a row for each value with its path, and
what the document is.  All rules are then selections of leaves; where one needs
what stands beside it (a container's name and limits, a backend's selector, an
environment entry's value), leaves are joined on their parents' path.  A value of
Helm finds the variable that it is given to by a join of its path with the
references in its chart's templates."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inventra.functions.registry import is_embedding, lookup
from inventra.functions.text import classify_endpoint, key_tokens, stripped
from inventra.operators.extract import COLUMNS, scanner
from inventra.sources.files import UNREAD, parsed
from inventra.tables import stored

# Cloud resources that hold AI assets, by cloud.
AWS = (
    "AWS::SageMaker::Endpoint", "AWS::SageMaker::Model", "AWS::SageMaker::NotebookInstance", "AWS::SageMaker::EndpointConfig", "AWS::Bedrock::Agent", "AWS::Bedrock::Guardrail", "AWS::Bedrock::KnowledgeBase", "AWS::Bedrock::DataSource",
    "aws_sagemaker_endpoint", "aws_sagemaker_model", "aws_sagemaker_endpoint_configuration", "aws_sagemaker_notebook_instance", "aws_bedrock_agent_agent", "aws_bedrock_guardrail", "aws_bedrock_knowledge_base", "aws_bedrockagent_data_source",
)
AZURE = (
    "Microsoft.CognitiveServices/accounts", "Microsoft.MachineLearningServices/workspaces", "Microsoft.MachineLearningServices/workspaces/onlineEndpoints", "Microsoft.MachineLearningServices/workspaces/computes",
    "azurerm_cognitive_account", "azurerm_machine_learning_workspace", "azurerm_machine_learning_online_endpoint", "azurerm_machine_learning_compute_instance",
)
GOOGLE = ("google_vertex_ai_endpoint", "google_vertex_ai_featurestore", "google_ml_engine_model", "google_notebooks_instance")
# Machines with accelerators; images of AI servers and of training, by what they contain.
ACCELERATED = r"(?i)(ml\.(p[345]d?|g[456]|trn1|inf[12])\.\w+|Standard_N[CDV]\w+|a2-(ultra|mega|high)gpu-\w+|n1-\w+-gpu\w*|g2-standard-\w+)"
IMAGES = ("ollama/ollama", "vllm/vllm-openai", "vllm/vllm", "ghcr.io/huggingface/text-generation-inference", "nvcr.io/nvidia/tritonserver", "nvcr.io/nvidia/tensorrt", "localai/localai", "bentoml/", "sagemaker-", "huggingface-pytorch-", "huggingface-tensorflow-")
TRAINING = ("huggingface", "sagemaker", "pytorch", "tensorflow", "training")
ACCELERATORS = ("nvidia.com/gpu", "amd.com/gpu")
# What is never a model's id, by value and by key.
NO_MODEL = r"(?i)(\.com/|\.io/|\.org/|\.dev/|dkr\.ecr|\.yaml$|\.yml$|\.json$|\.py$|\.tf$|\.crt$|\.key$|\.pem$|\.sh$|^arn:|^https?://|^ssh://|^git@|kubernetes\.io/|helm\.sh/|^actions/|@v\d+$|/secrets?/|/configmaps?/|/templates?/|^envoyproxy/|^nginx/|^redis/|^postgres/|^mysql/|^mongo)"
NO_MODEL_KEY = r"(?i)((^|\.)tag$|(^|\.)image_tag$|(^|\.)version$|_threshold$|_timeout$|_ip$|_host$|_port$|_url$|\.environment$)"
MODEL_KEYS = ("model", "model_name", "model_id", "llm_model", "llm", "deployment", "engine", "embedding", "embedding_model", "default_model", "chat_model", "completion_model")
ENDPOINT_KEY = r"(endpoint|api_base|api_url|base_url)$"
# Variables by what they hold; words of keys; stores by name, in order.
SECRETS = ("OPENAI_API_KEY", "ANTHROPIC_API_KEY", "HUGGINGFACE_TOKEN", "HF_TOKEN", "COHERE_API_KEY", "MISTRAL_API_KEY", "AZURE_OPENAI_API_KEY", "GOOGLE_AI_API_KEY")
ENDPOINTS = ("AZURE_OPENAI_ENDPOINT", "OPENAI_API_BASE", "AZURE_OPENAI_API_BASE", "ANTHROPIC_API_BASE", "MODEL_ENDPOINT", "INFERENCE_ENDPOINT", "AWS_SAGEMAKER_ENDPOINT", "INFERENCE_URL")
MODELS = ("MODEL_NAME", "MODEL_ID", "MODEL_PATH", "EMBEDDING_MODEL", "LLM_MODEL")
EMBEDDING = ("embedding", "embeddings", "embed", "embedder")
STORES = (("weaviate", "weaviate"), ("pinecone", "pinecone"), ("qdrant", "qdrant"), ("chromadb", "chromadb"), ("chroma", "chromadb"), ("milvus", "milvus"), ("pgvector", "pgvector"), ("faiss", "faiss"), ("redis", "redis"))
WORKLOADS = ("Deployment", "StatefulSet", "Job", "CronJob")

#: The parser in C where it is there; nodes and lines are the same.
LOADER = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
LEAVES = "shape string, document int, kind string, at array<string>, key string, value string, type string, line int"
_KINDS = {"str": "text", "int": "int", "bool": "bool", "float": "float", "null": "null"}
_ASSIGNED = re.compile(r"(?m)^\s*([a-zA-Z_]\w*)\s*=\s*\"([^\"]*)\"")


def _shape(name: str, content: str, keys: dict) -> str | None:
    """What a document is, by its file's name and its top."""
    if re.fullmatch(r"(?i)values(-.*)?\.ya?ml", name):
        return "helm"
    held = keys.get("Resources")
    if "AWSTemplateFormatVersion" in keys or (isinstance(held, dict) and any(isinstance(v, dict) and str(v.get("Type", "")).startswith("AWS::") for v in held.values())):
        return "cloudformation"
    if "deploymenttemplate" in str(keys.get("$schema", "")).lower():
        return "arm"
    if {"apiVersion", "kind"} <= set(keys) or ("apiVersion" in content and "kind:" in content) or re.fullmatch(r"(?i)kustomization\.ya?ml", name):
        return "k8s"
    return None


def _plain(node) -> object:
    """Keys and scalar texts of a node, two levels down: enough to tell its shape."""
    if not isinstance(node, yaml.MappingNode):
        return node.value if isinstance(node, yaml.ScalarNode) else None
    return {k.value: {x.value: y.value for x, y in v.value if isinstance(y, yaml.ScalarNode)} | {x.value: _plain(y) for x, y in v.value if isinstance(y, yaml.MappingNode)} if isinstance(v, yaml.MappingNode) else _plain(v) for k, v in node.value if isinstance(k, yaml.ScalarNode)}


def leaves_of(node, at: tuple[str, ...]) -> list[tuple[tuple[str, ...], str, str, int]]:
    """(path, value, type, line) of all scalars below a node; one that holds itself ends there."""
    found: list[tuple] = []
    above: set[int] = set()

    def walk(node, at: tuple[str, ...], line: int | None) -> None:
        if isinstance(node, yaml.ScalarNode):
            kind = _KINDS.get(node.tag.rsplit(":", 1)[-1], "tagged")
            found.append((at, node.value, kind, node.start_mark.line + 1 if line is None else line))
        elif id(node) not in above:
            above.add(id(node))
            if isinstance(node, yaml.MappingNode):
                for k, v in node.value:
                    if isinstance(k, yaml.ScalarNode):
                        walk(v, (*at, k.value), k.start_mark.line + 1)
            else:
                for i, v in enumerate(node.value):
                    walk(v, (*at, f"[{i}]"), None)
            above.discard(id(node))

    walk(node, at, None)
    return found


def _block(text: str, opening: int) -> str:
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, opening):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return text[opening : m.end()]
    return text[opening:]


def _terraform(content: str) -> Iterator[tuple[tuple[str, ...], str, str, int]]:
    line = lambda i: content.count("\n", 0, i) + 1
    for m in re.finditer(r'resource\s+"([^"]+)"\s+"([^"]+)"', content):
        yield ("resource", m[1], m[2]), "", "block", line(m.start())
        opening = content.find("{", m.end())
        if opening >= 0:
            yield from ((("resource", m[1], m[2], a[1]), a[2], "text", line(opening + a.start())) for a in _ASSIGNED.finditer(_block(content, opening)))
    for m in re.finditer(r'variable\s+"([^"]+)"\s*\{[^}]*default\s*=\s*"([^"]*)"', content):
        yield ("variable", m[1], "default"), m[2], "text", line(m.start())
    for m in re.finditer(r"(?m)^\s*locals\s*\{", content):
        opening = content.find("{", m.start())
        yield from ((("locals", a[1]), a[2], "text", line(opening + a.start())) for a in _ASSIGNED.finditer(_block(content, opening)))


def _bicep(content: str) -> Iterator[tuple[tuple[str, ...], str, str, int]]:
    line = lambda i: content.count("\n", 0, i) + 1
    for m in re.finditer(r"resource\s+\w+\s+'([^']+)'", content):
        yield ("resource", m[1].split("@")[0].strip()), "", "block", line(m.start())
    for m in re.finditer(r"param\s+(\w+)\s+\w+\s*=\s*'([^']*)'", content):
        yield ("param", m[1]), m[2], "text", line(m.start())


_GIVEN = re.compile(r"-\s*name:\s*(\S+)\s*\n\s*value:\s*.*?\.Values\.(\S+?)[\s\}]")


def _documents(root: str, path: str, content: str) -> Iterator[tuple]:
    """LEAVES of one file."""
    name = path.rsplit("/", 1)[-1]
    if name.endswith((".tf", ".bicep")):
        shape = "terraform" if name.endswith(".tf") else "bicep"
        for at, value, kind, line in (_terraform if shape == "terraform" else _bicep)(content):
            yield shape, 0, None, list(at), at[-1], value, kind, line
        return
    if name.endswith(".json"):
        json.loads(content)  # what isn't JSON isn't read as YAML
    try:
        nodes = [n for n in yaml.compose_all(content.replace("\t", "  ") if name.endswith(".json") else content, Loader=LOADER) if n is not None]
    except yaml.YAMLError:
        return
    for i, node in enumerate(nodes):
        keys = _plain(node)
        shape = _shape(name, content, keys) if isinstance(keys, dict) else None
        if shape and (shape in ("cloudformation", "arm") or not name.endswith(".json")):
            kind = keys.get("kind") if isinstance(keys.get("kind"), str) else None
            for at, value, kind_of, line in leaves_of(node, ()):
                yield shape, i, kind, list(at), at[-1] if at else "", value, kind_of, line


def _given(path: str, content: str) -> Iterator[tuple]:
    """Variables of a chart's template that are given a value of it, in the form of
    LEAVES: the chart and the value's path, and the variable as value."""
    if re.search(r"(^|/)templates/.*\.yaml\Z", path):
        chart = re.match(r"(?s)(.*?)(?:^|(?<=/))templates/", path)
        for m in _GIVEN.finditer(content):
            yield "template", 0, None, [chart[1], m[2].strip().rstrip(" }|")], "", m[1].strip("\"'"), "template", 0


def read(files: DataFrame) -> DataFrame:
    """root, path and LEAVES, and of templates what they give to variables (shape
    template): each file is read once.  Places in lists are [0], [1] and so on."""
    def parse(root: str, path: str, content: str) -> list[tuple]:
        try:
            found = list(_documents(root, path, content))
        except UNREAD:
            found = []  # a file that can't be read may still be a template
        return found + list(_given(path, content))

    return parsed(files.where(F.col("path").rlike(r"(?i)\.(tf|bicep|json|ya?ml)$")), parse, LEAVES)


def leaves(files: DataFrame) -> DataFrame:
    """root, path and LEAVES, without templates' variables."""
    return read(files).where("shape <> 'template'")


def _contains(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [F.contains(F.lower(c), F.lit(w)) for w in words])


def is_ai_image(c: Column) -> Column:
    return _contains(c, IMAGES)


def _technology(c: Column) -> Column:
    return F.coalesce(*(F.when(F.contains(F.lower(c), F.lit(word)), name) for word, name in STORES))


def _known(rows: DataFrame, models: DataFrame | None) -> DataFrame:
    """rows with ``known`` and ``embeds``: the registry knows the text as a model,
    and as one that embeds.  Without a registry's table there is nothing to join."""
    asked = (F.col("type") == "text") & (F.col("text") != "") & (F.length("text") <= 256) & ~F.col("text").rlike(NO_MODEL)
    if models is None:
        told = lookup(rows.withColumn("model", F.when(asked, F.col("text"))), None)
        out = told.select(*rows.columns, F.col("source").isNotNull().alias("known"), is_embedding().alias("embeds"))
    else:
        values = rows.where(asked).select(F.col("text").alias("model")).distinct()
        told = lookup(values, models).select(F.col("model").alias("text"), F.col("source").isNotNull().alias("known"), is_embedding().alias("embeds"))
        out = rows.join(told, "text", "left").withColumns({"known": F.coalesce("known", F.lit(False)), "embeds": F.coalesce("embeds", F.lit(False))})
    return out.withColumn("embeds", F.col("embeds") | F.lower("text").startswith("text-embedding"))


def _words_in(c: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(key_tokens(c), F.array(*map(F.lit, words)))


def _model_type(key: Column) -> Column:
    return F.when(F.col("embeds") | _words_in(key, EMBEDDING), "embedding").otherwise("model")


def _in(*names: str) -> Column:
    return F.array(*map(F.lit, names))


_OUT = ["root", "path", "line", "name", "component_type", "model_name", "confidence", "needs_agentic", "shape", "place", "env_var", "technology", "first"]


def _found(test: Column | str, name: Column, kind: Column | str, first: int, model: Column | None = None, confidence: Column | float = 1.0, review: Column | bool = False, place: Column | None = None, env: Column | None = None, technology: Column | None = None) -> Column:
    """What a rule tells of a row that passes its test; else null."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    none = F.lit(None).cast("string")
    values = [F.substring(name, 1, 200), lit(kind), none if model is None else model, lit(confidence), lit(review), F.col("shape"), dotted_path(F.col("at")) if place is None else place, none if env is None else env, none if technology is None else technology, F.struct(F.lit(first).alias("rule"), F.col("ord").alias("ord"))]
    return F.when(F.expr(test) if isinstance(test, str) else test, F.struct(*(v.alias(c) for v, c in zip(values, _OUT[3:], strict=True))))


def _all(rows: DataFrame, *found: Column) -> DataFrame:
    """What several rules tell of the same rows, in one pass over them."""
    return rows.select("root", "path", "line", F.inline(F.array_compact(F.array(*found))))


def dotted_path(at: Column) -> Column:
    """a.b[0].c of a path."""
    return F.replace(F.array_join(at, "."), F.lit(".["), F.lit("["))


def templates(rows: DataFrame) -> DataFrame:
    """root, chart, value, env: variables of a chart's templates (rows of ``read``)
    that are given a value of it; of several the last in order of files counts."""
    own = rows.where("shape = 'template'").select("root", F.col("at")[0].alias("chart"), F.col("at")[1].alias("value"), F.col("value").alias("env"), "path", "ord")
    return own.groupBy("root", "chart", "value").agg(F.max_by("env", F.struct("path", "ord")).alias("env"))


def _charts(files: DataFrame, values: DataFrame) -> DataFrame:
    """root, path, chart: of files with values, the nearest folder of theirs, at most
    four above, that has a Chart.yaml or templates."""
    has = files.where(F.col("path").rlike(r"(^|/)(Chart\.yaml$|templates/)")).select("root", F.regexp_extract("path", r"(?s)^(.*?)(?:Chart\.yaml$|templates/.*$)", 1).alias("chart")).distinct()
    folders = F.split(F.regexp_replace("path", "[^/]*$", ""), "(?<=/)")
    above = F.transform(F.sequence(F.lit(0), F.least(F.lit(4), F.size(folders) - 1)), lambda k: F.array_join(F.slice(folders, 1, F.size(folders) - 1 - k), ""))
    each = values.select("root", "path").distinct().select("root", "path", F.posexplode(above).alias("up", "chart"))
    return each.join(has, ["root", "chart"]).groupBy("root", "path").agg(F.min_by("chart", "up").alias("chart"))


def _helm(rows: DataFrame, files: DataFrame) -> list[DataFrame]:
    h = rows.where("shape = 'helm' and not startswith(key, '[')").withColumn("dotted", dotted_path(F.col("at"))).withColumn("parent", F.slice("at", 1, F.size("at") - 1))
    to = _charts(files, h).join(templates(rows), ["root", "chart"]).select("root", "path", F.col("value").alias("dotted"), "env")
    h = h.join(to, ["root", "path", "dotted"], "left")
    given = F.coalesce("env", "key")
    parts = F.split(F.replace(F.lower("dotted"), F.lit("-"), F.lit("_")), r"\.")
    image = is_ai_image(F.col("value"))
    model = ~image & ~F.col("dotted").rlike(NO_MODEL_KEY) & F.col("known")
    endpoint = ~image & ~model & F.lower("key").rlike(ENDPOINT_KEY) & F.col("text").rlike("^https?://")
    maybe = ~image & ~model & ~endpoint & F.arrays_overlap(parts, _in(*MODEL_KEYS)) & (F.col("text") != "") & (F.length("text") < 120)
    text = h.where("type = 'text'")
    # What stands beside an endpoint: which backend is chosen, and which model.
    beside = text.select("root", "path", "document", "parent", F.col("key").alias("b_key"), F.col("text").alias("b_text"), "known", "embeds", F.col("ord").alias("b_ord"))
    tokens = key_tokens(F.col("b_key"))
    chosen = F.arrays_overlap(tokens, _in("backend", "provider")) | (F.array_contains(tokens, "type") & F.arrays_overlap(tokens, _in("vector", "db", "store")))
    stated = F.when(chosen & _technology(F.col("b_text")).isNotNull(), F.struct("b_ord", _technology(F.col("b_text")).alias("t")))
    pair = F.when(F.col("known"), F.struct("b_ord", F.when(F.col("embeds"), "embedding").otherwise("llm").alias("p")))
    around = beside.groupBy("root", "path", "document", "parent").agg(F.min(stated).alias("stated"), F.min(pair).alias("pair"))
    h = h.join(around, ["root", "path", "document", "parent"], "left")
    hinted = _technology(F.concat_ws(" ", "dotted", "text"))
    kind = F.when(F.col("stated").isNotNull() | hinted.isNotNull(), "vector_store").otherwise(classify_endpoint(F.col("text"), F.col("dotted"), F.col("pair.p")))
    unsure = (kind == "llm_endpoint") | F.coalesce(F.col("stated").isNotNull() & (hinted != F.col("stated.t")), F.lit(False))
    variable = F.when(given != F.col("key"), given)
    is_text = F.col("type") == "text"
    return [_all(
        h,
        _found(is_text & image, F.col("value"), "dependency", 0),
        _found(is_text & model, F.col("text"), _model_type(F.col("dotted")), 0, F.col("text"), 0.95, True, env=variable),
        _found(is_text & endpoint, F.col("text"), kind, 0, None, F.when(unsure, 0.5).otherwise(0.95), unsure, env=given, technology=F.coalesce("stated.t", hinted)),
        _found(is_text & maybe, F.col("text"), _model_type(F.col("dotted")), 0, F.col("text"), 0.5, True, env=variable),
        _found("lower(key) = 'gpu' and type = 'int' and try_cast(value as int) > 0", F.concat(F.lit("gpu:"), F.col("dotted")), "training_run", 0),
    )]


def _variables(test: Column | str, key: Column, value: Column, first: int) -> Column:
    """Components of variables that are known by name: env:NAME."""
    url = stripped(value).rlike("^https?://")
    held = F.coalesce(stripped(value), F.lit(""))
    kind = F.when(key.isin(*SECRETS), "secret").when(key.isin(*ENDPOINTS) & url, F.when(_technology(F.concat_ws(" ", key, held)).isNotNull(), "vector_store").otherwise(classify_endpoint(held, key))).otherwise(F.when(F.lower(held).startswith("text-embedding") | F.coalesce(F.col("embeds"), F.lit(False)) | _words_in(key, EMBEDDING), "embedding").otherwise("model"))
    return _found(test, F.concat(F.lit("env:"), key), kind, first, F.when(kind != "secret", F.when(held != "", held)), env=key)


def _kubernetes(rows: DataFrame) -> list[DataFrame]:
    k = rows.where("shape = 'k8s'")
    named = (*SECRETS, *ENDPOINTS, *MODELS)
    notes = (F.col("kind") == "Service") & (F.size("at") == 3) & (F.slice("at", 1, 2) == _in("metadata", "annotations")) & F.col("known")
    data = F.col("kind").isin("ConfigMap", "Secret") & (F.size("at") == 2) & F.col("at")[0].isin("data", "stringData") & (F.col("type") == "text")
    # A pod stands below spec.template.spec, or spec.spec.
    pod = F.array_position("at", "containers") + F.array_position("at", "initContainers")
    spec = (F.slice("at", 1, 3) == _in("spec", "template", "spec")) | (F.slice("at", 1, 2) == _in("spec", "spec"))
    c = k.where(F.col("kind").isin(*WORKLOADS) & spec & (pod > 0)).withColumn("at_pod", pod.cast("int"))
    c = c.where("at_pod in (3, 4) and size(at) > at_pod + 1").withColumn("box", F.slice("at", 1, F.col("at_pod") + 1)).withColumn("rest", F.slice("at", F.col("at_pod") + 2, F.size("at")))
    about = c.groupBy("root", "path", "document", "box").agg(
        F.max(F.when(F.col("rest") == _in("name"), F.col("value"))).alias("box_name"),
        F.coalesce(F.max((F.slice("rest", 1, 2) == _in("resources", "limits")) & F.col("key").isin(*ACCELERATORS)), F.lit(False)).alias("gpu"),
    )
    image = c.where((F.col("rest") == _in("image")) & (F.col("type") == "text")).join(about, ["root", "path", "document", "box"])
    env = c.where((F.col("rest")[0] == "env") & (F.size("rest") == 3)).withColumn("entry", F.slice("at", 1, F.size("at") - 1))
    value = env.where("key = 'value'").select("root", "path", "document", "entry", F.when(F.col("type") == "text", F.col("value")).otherwise("").alias("given"), F.col("embeds").alias("_e"))
    entry = env.where((F.col("key") == "name") & F.col("value").isin(*named)).drop("embeds").join(value, ["root", "path", "document", "entry"], "left").withColumn("embeds", F.col("_e"))
    trains = F.col("gpu") & F.col("kind").isin("Job", "CronJob") & _contains(F.col("value"), TRAINING)
    return [
        _all(
            k, _found(notes, F.col("text"), "model", 0, F.col("text"), 0.95),
            _variables(data & F.col("key").isin(*named) & (F.col("text") != ""), F.col("key"), F.col("value"), 0), _found(data & F.col("known"), F.col("text"), "model", 1, F.col("text"), 0.95),
        ),
        _all(image, _found(is_ai_image(F.col("value")), F.col("value"), "dependency", 0), _found(trains, F.concat(F.lit("training:"), F.coalesce("box_name", F.lit("job"))), "training_run", 1)),
        _all(entry, _variables("true", F.col("value"), F.col("given"), 0)),
    ]


def _cloud(rows: DataFrame) -> list[DataFrame]:
    f = rows.where("shape = 'cloudformation'").withColumn("line", F.lit(1))
    is_kind = (F.col("at")[0] == "Resources") & (F.size("at") == 3) & (F.col("key") == "Type") & F.col("value").isin(*AWS)
    kind = f.where(is_kind)
    own = f.where((F.col("at")[0] == "Resources") & (F.col("at")[2] == "Properties") & (F.col("type") == "text") & (F.col("text") != "")).withColumn("resource", F.col("at")[1])
    own = own.join(kind.select("root", "path", "document", F.col("at")[1].alias("resource")), ["root", "path", "document", "resource"], "left_semi").withColumn("low", F.lower("key"))
    defaults = (F.col("at")[0] == "Parameters") & (F.size("at") == 3) & (F.col("key") == "Default") & F.col("known")
    a = rows.where("shape = 'arm'").withColumn("line", F.lit(1)).withColumn("resource", F.col("at")[1])
    azure = F.trim(F.split_part("value", F.lit("@"), F.lit(1)))
    typed = a.where((F.col("at")[0] == "resources") & (F.size("at") == 3) & (F.col("key") == "type") & azure.isin(*AZURE)).withColumn("is", azure)
    names = a.where((F.col("at")[0] == "resources") & (F.size("at") == 3) & (F.col("key") == "name") & (F.col("type") == "text")).select("root", "path", "document", "resource", F.col("value").alias("called"))
    typed = typed.join(names, ["root", "path", "document", "resource"], "left")
    inside = a.where((F.col("at")[0] == "resources") & (F.col("at")[2] == "properties") & (F.col("type") == "text")).join(typed.select("root", "path", "document", "resource", "is"), ["root", "path", "document", "resource"])
    # A deployment's model is known by its name, or where it has none by its format.
    deployed = inside.where((F.col("is") == AZURE[0]) & (F.col("at")[3] == "deployments") & (F.size("at") == 7) & (F.col("at")[5] == "model") & F.col("key").isin("name", "format") & (F.col("value") != "")).withColumn("entry", F.col("at")[4])
    first = deployed.groupBy("root", "path", "document", "resource", "entry").agg(F.max("key").alias("key"))
    deployed = deployed.join(first, ["root", "path", "document", "resource", "entry", "key"], "left_semi")
    sku = (F.slice("at", 4, 2) == _in("sku", "name")) & (F.size("at") == 5) & F.col("value").rlike(ACCELERATED)
    given = (F.col("at")[0] == "parameters") & (F.size("at") == 3) & F.col("key").isin("defaultValue", "default") & F.col("known")
    return [
        _all(f, _found(is_kind, F.col("at")[1], "other", 0), _found(defaults, F.col("text"), "model", 0, F.col("text"), 0.95)),
        _all(
            own, _found("low in ('modelid', 'model_id', 'modelname', 'model_name')", F.col("text"), "model", 0, F.col("text")),
            _found(F.col("low").isin("instancetype", "instance_type") & F.col("value").rlike(ACCELERATED), F.concat(F.lit("gpu_instance:"), "value"), "training_run", 0),
            _found("contains(low, 's3') and contains(low, 'model') and startswith(value, 's3://')", F.col("value"), "model_artifact", 0),
        ),
        _all(typed, _found("true", F.coalesce("called", F.lit("resource")), "other", 0)), _all(deployed, _found("known", F.col("text"), "model", 0, F.col("text"), 0.95)),
        _all(inside, _found(sku, F.concat(F.lit("sku:"), "value"), "training_run", 0)), _all(a, _found(given, F.col("text"), "model", 0, F.col("text"), 0.95)),
    ]


def _declared(rows: DataFrame) -> list[DataFrame]:
    t = rows.where("shape = 'terraform'").withColumn("low", F.lower("key"))
    own = (F.col("at")[0] == "resource") & F.col("at")[1].isin(*AWS, *AZURE, *GOOGLE)
    fields = own & F.expr("type = 'text' and text <> ''")
    rest = (F.col("at")[0] == "variable") | ((F.col("at")[0] == "locals") & _contains(F.col("key"), ("model", "image", "endpoint", "llm", "embedding", "gpu")))
    b = rows.where("shape = 'bicep'")
    return [
        _all(
            t, _found(own & (F.col("type") == "block"), F.concat_ws(".", F.col("at")[1], F.col("at")[2]), "other", 0), _found(fields & F.expr("low in ('model_id', 'model_name', 'model_data_url')"), F.col("value"), "model", 0, F.col("value")),
            _found(fields & F.col("low").isin("image", "container_image") & is_ai_image(F.col("value")), F.col("value"), "dependency", 0),
            _found(fields & (F.col("low") == "instance_type") & F.col("value").rlike(ACCELERATED), F.concat(F.lit("gpu_instance:"), "value"), "training_run", 0),
            _found(rest & F.col("known"), F.col("text"), "model", 0, F.col("text"), 0.95), _found(rest & is_ai_image(F.col("value")), F.col("value"), "dependency", 1),
        ),
        _all(b, _found((F.col("at")[0] == "resource") & F.col("key").isin(*AZURE), F.col("key"), "other", 0), _found((F.col("at")[0] == "param") & F.col("known"), F.col("text"), "model", 0, F.col("text"), 0.95)),
    ]


def components(files: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """root, path, line, name, component_type, model_name, confidence,
    needs_agentic, shape, place (the value's path), env_var, technology: one row for
    each file, line and name, that of its first value.  models: a registry's table;
    without one the patterns of known families count."""
    held = read(files) if models is None else stored(read(files))
    rows = stored(_known(held.withColumn("text", stripped(F.col("value"))), models))
    found = reduce(DataFrame.unionByName, [*_helm(rows, files), *_kubernetes(rows), *_cloud(rows), *_declared(rows)])
    rest = [c for c in _OUT if c not in ("root", "path", "line", "name", "first")]
    best = found.groupBy("root", "path", "line", "name").agg(F.min_by(F.struct(*rest), F.struct(F.col("first.ord"), F.col("first.rule"))).alias("m"))
    return best.select("root", "path", "line", "name", "m.*")


@scanner("infrastructure")
def infrastructure_components(files: DataFrame) -> DataFrame:
    c = components(files).withColumn("framework", F.col("shape")).withColumn("scanner", F.lit("infrastructure"))
    return c.select(*COLUMNS)
