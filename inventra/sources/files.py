"""Reading source trees and what stands in configuration files.

A tree becomes ``files(root, path, content, length)``.  Parsers run as one
Arrow pass over the files of their kind; the filter by name stands before it."""

from __future__ import annotations

import fnmatch
import json
import re
import tomllib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from inventra.functions.text import OPERATORS, in_skipped_dir, normal_path
from inventra.tables import stored


def read_tree(spark: SparkSession, roots: list[str], excludes: list[str] = (), ignore: list[str] = ()) -> DataFrame:
    """Files below the roots with paths relative to theirs, without skipped
    directories and what the patterns exclude."""
    out = None
    for root in roots:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        base = re.sub(r"^[a-z]+:/*", "/", root).rstrip("/")
        path = F.regexp_replace("path", f"^[a-z]+:/*{re.escape(base)}/", "")
        own = raw.select(F.lit(root).alias("root"), path.alias("path"), F.col("content").alias("raw"), "length", F.col("modificationTime").alias("mtime"))
        out = own if out is None else out.unionByName(own)
    out = out.where(~in_skipped_dir(F.col("path")))
    for pattern in [*excludes, *ignore]:
        out = out.where(~F.col("path").rlike(_glob(pattern)))
    return out.withColumn("content", F.col("raw").try_cast("string") if hasattr(F.col("raw"), "try_cast") else F.col("raw").cast("string"))


def _glob(pattern: str) -> str:
    """A line of an ignore file as a regular expression on relative paths."""
    p = pattern.strip().rstrip("/")
    body = fnmatch.translate(p.lstrip("/")).removeprefix("(?s:").removesuffix(r")\z").removesuffix(r")\Z")
    body = body.replace("(?>.*?/)", "(?:.*/)?")
    return f"{'^' if p.startswith('/') else '(^|/)'}{body}(/|$)"


def ignore_lines(text: str) -> list[str]:
    return [x.strip() for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]


def extension() -> "F.Column":
    return F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))


def notebooks(files: DataFrame) -> DataFrame:
    """Code cells of notebooks joined by empty lines; magic lines as comments.
    A cell's source may be a list or a string."""
    cells = F.from_json("content", "struct<cells:array<struct<cell_type:string,source:string>>>")["cells"]
    code = F.transform(F.filter(cells, lambda c: c["cell_type"] == "code"), lambda c: F.when(c["source"].startswith("["), F.concat_ws("", F.from_json(c["source"], "array<string>"))).otherwise(c["source"]))
    text = F.concat_ws("\n\n", F.transform(code, lambda c: F.regexp_replace(c, r"(?m)^([%!])", "# MAGIC: $1")))
    return files.where(extension() == ".ipynb").withColumn("content", text)


def spread(files: DataFrame) -> DataFrame:
    """The files over as many tasks as a shuffle has.  By its size a packed table of
    short files is read by one task or two, which then do all the work on them."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "root", "path")


#: What a parser may raise at a file that can't be read.
UNREAD = (ValueError, KeyError, TypeError, AttributeError, RecursionError, SyntaxError)


def parsed(files: DataFrame, parse, schema: str) -> DataFrame:
    """``parse(root, path, content)`` yields rows of ``schema``; a file that
    can't be read gives none.  ord numbers rows within their file.  How many there
    are can't be told from the files' size, so joins never broadcast them."""
    kind = StructType.fromDDL(f"root string, path string, {schema}, ord int")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for root, path, content in zip(*(batch[c].to_pylist() for c in ("root", "path", "content")), strict=True):
                try:
                    found = list(parse(root, path, content or ""))
                except UNREAD:
                    found = []
                rows += [(root, path, *r, i) for i, r in enumerate(found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(arrow)], schema=arrow)

    return spread(files.select("root", "path", "content")).mapInArrow(run, kind).hint("merge")


# --- configuration ---------------------------------------------------------

_ENV_LINE = re.compile(r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$")
_TFVARS = re.compile(r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*=\s*\"([^\"]*)\"")


def _unquoted(v: str) -> str:
    return v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" else v


def _leaves(node, key: str = ""):
    """(leaf key, value) of a nested document, in order."""
    if isinstance(node, dict):
        for k, v in node.items():
            yield from _leaves(v, str(k))
    elif isinstance(node, list):
        for v in node:
            yield from _leaves(v, key)
    elif key and node is not None:
        yield key, str(node)


def yaml_documents(text: str) -> list:
    import yaml

    # The parser in C where it is there; it gives the same documents.
    return [x for x in yaml.load_all(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)) if x is not None]


def parse_env(root: str, path: str, content: str):
    """name, value, line, kind of each definition."""
    name = path.rsplit("/", 1)[-1]
    if name == ".env" or name.startswith(".env.") or name.endswith(".env"):
        for i, line in enumerate(content.splitlines(), 1):
            if not line.lstrip().startswith("#") and (m := _ENV_LINE.match(line)):
                yield m[1], _unquoted(m[2]), i, "dotenv"
    elif name.endswith(".tfvars"):
        for i, line in enumerate(content.splitlines(), 1):
            if m := _TFVARS.match(line):
                yield m[1], m[2], i, "tfvars"
    elif re.match(r"(docker-)?compose.*\.ya?ml$", name):
        for doc in yaml_documents(content):
            for service in (doc.get("services") or {}).values():
                env = service.get("environment") or {}
                pairs = env.items() if isinstance(env, dict) else (x.partition("=")[::2] for x in env)
                for k, v in pairs:
                    yield str(k), "" if v is None else str(v), 0, "compose"
    elif name in ("values.yaml", "values.yml"):
        for doc in yaml_documents(content):
            for k, v in _leaves(doc):
                yield k, v, 0, "helm"
    elif re.search(r"\.ya?ml$", name):
        for doc in yaml_documents(content):
            if isinstance(doc, dict) and doc.get("kind") == "ConfigMap":
                for k, v in (doc.get("data") or {}).items():
                    yield str(k), str(v), 0, "configmap"


def env_index(files: DataFrame) -> DataFrame:
    """Definitions in order of path and place, so that the first can win."""
    own = files.where(F.col("path").rlike(r"(^|/)(\.env(\..*)?|[^/]*\.env|[^/]*\.tfvars|[^/]*\.ya?ml)$"))
    return parsed(own, parse_env, "name string, value string, line int, source_type string")


# --- manifests -------------------------------------------------------------

_NAME = re.compile(r"[a-zA-Z0-9](?:[a-zA-Z0-9._-]*[a-zA-Z0-9])?")


def pinned_version(spec: str) -> str | None:
    """The exact version of a version part that begins behind == or ===."""
    if "==" in spec:
        return spec.split("==", 1)[1].lstrip("=").strip()
    return spec if re.fullmatch(r"[0-9][0-9a-zA-Z._\-*!]*", spec) else None


def _requirement(text: str, line: int):
    """name, version part, line, pin and ecosystem of a requirement; extras and
    markers go, and a version alone is none."""
    base = text.split(";", 1)[0].split(" #", 1)[0].strip()
    if not base or base.startswith(("#", "-")) or "://" in base:
        return
    op = next((o for o in OPERATORS if o in base), None)
    name, _, spec = base.partition(op) if op else (base, "", "")
    m = _NAME.match(name.split("[", 1)[0].strip())
    if m and not re.fullmatch(r"[vV]?\d+(\.\d+)+[a-zA-Z0-9._-]*", m[0]):
        spec = spec.strip()
        yield m[0], spec or "*", line, pinned_version(spec) if op in ("==", "===") else None, "pypi"


def _pin(spec: str) -> str | None:
    m = re.search(r"===?\s*([^\s,;]+)", spec)
    return m[1] if m else None


def parse_manifest(root: str, path: str, content: str):
    """name, spec, line, pin, ecosystem of each dependency."""
    name = path.rsplit("/", 1)[-1]
    lines = content.splitlines()
    at = lambda needle: next((i for i, x in enumerate(lines, 1) if needle in x), 0)
    npm_pin = lambda v: v if re.fullmatch(r"\d+\.\d+\.\d+[\w.-]*", v) else None
    if re.match(r"requirements.*\.txt$", name):
        for i, line in enumerate(lines, 1):
            yield from _requirement(line, i)
    elif name == "pyproject.toml":
        doc = tomllib.loads(content)
        project = doc.get("project", {})
        for spec in [*project.get("dependencies", []), *(x for v in project.get("optional-dependencies", {}).values() for x in v)]:
            yield from _requirement(spec, at(spec))
        poetry = doc.get("tool", {}).get("poetry", {})
        for k, v in poetry.get("dependencies", {}).items():
            if k != "python":
                v = v if isinstance(v, str) else str((v or {}).get("version", ""))
                yield k, v, at(k), v if re.fullmatch(r"\d[\w.]*", v) else None, "pypi"
    elif name == "Pipfile":
        doc = tomllib.loads(content)
        for part in ("packages", "dev-packages"):
            for k, v in doc.get(part, {}).items():
                v = v if isinstance(v, str) else str(v.get("version", ""))
                yield k, v, at(k), _pin(v), "pypi"
    elif name in ("poetry.lock", "uv.lock"):
        for p in tomllib.loads(content).get("package", []):
            yield p["name"], f"=={p.get('version', '')}", at(f'name = "{p["name"]}"'), p.get("version"), "pypi"
    elif name in ("setup.py", "setup.cfg"):
        for m in re.finditer(r"[\"']?([A-Za-z0-9][\w.-]*)\s*((?:[<>=!~]=?=?)\s*[\w.*]+)[\"']?", content):
            yield m[1], m[2], content.count("\n", 0, m.start()) + 1, _pin(m[2]), "pypi"
    elif name == "package.json":
        doc = json.loads(content)
        for part in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
            for k, v in (doc.get(part) or {}).items():
                yield k, v, at(f'"{k}"'), npm_pin(v), "npm"
    elif name == "package-lock.json":
        for k, v in (json.loads(content).get("packages") or {}).items():
            if "node_modules/" in k:
                yield k.rsplit("node_modules/", 1)[1], v.get("version", ""), 0, v.get("version"), "npm"
    elif name == "pnpm-lock.yaml":
        for k in next(iter(yaml_documents(content)), {}).get("packages") or {}:
            m = re.match(r"/?(@?[^@(]+)@([^(]+)", str(k))
            if m:
                yield m[1], m[2], at(str(k)), m[2], "npm"
    elif name == "yarn.lock":
        for m in re.finditer(r'^"?(@?[^@\s"]+)@[^\n]*:\n\s+version "?([^"\s]+)', content, re.M):
            yield m[1], m[2], content.count("\n", 0, m.start()) + 1, m[2], "npm"
    elif name == "Cargo.toml":
        for k, v in tomllib.loads(content).get("dependencies", {}).items():
            v = v if isinstance(v, str) else str(v.get("version", ""))
            yield k, v, at(k), v.removeprefix("=") if v.startswith("=") else None, "cargo"
    elif name == "go.mod":
        for i, line in enumerate(lines, 1):
            if m := re.match(r"^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/\S+)\s+(v\S+)", line):
                yield m[1], m[2], i, m[2], "go"
    elif name == "Gemfile":
        for i, line in enumerate(lines, 1):
            if m := re.match(r"^\s*gem\s+[\"']([^\"']+)[\"'](?:\s*,\s*[\"']([^\"']+)[\"'])?", line):
                yield m[1], m[2] or "", i, m[2] if m[2] and re.fullmatch(r"[\d.]+", m[2]) else None, "rubygems"
    elif name == "pom.xml":
        for m in re.finditer(r"<dependency>\s*<groupId>([^<]+)</groupId>\s*<artifactId>([^<]+)</artifactId>(?:\s*<version>([^<]+)</version>)?", content):
            yield f"{m[1]}:{m[2]}", m[3] or "", content.count("\n", 0, m.start()) + 1, m[3], "maven"
    elif name in ("build.gradle", "build.gradle.kts"):
        for m in re.finditer(r"(?:implementation|api|compileOnly|runtimeOnly)\s*\(?\s*[\"']([^:\"']+):([^:\"']+):([^\"']+)[\"']", content):
            yield f"{m[1]}:{m[2]}", m[3], content.count("\n", 0, m.start()) + 1, m[3], "maven"
    elif name.endswith(".csproj"):
        for m in re.finditer(r"<PackageReference\s+Include=\"([^\"]+)\"(?:\s+Version=\"([^\"]+)\")?", content):
            yield m[1], m[2] or "", content.count("\n", 0, m.start()) + 1, m[2], "nuget"


MANIFESTS = r"(^|/)(requirements[^/]*\.txt|pyproject\.toml|Pipfile|poetry\.lock|uv\.lock|setup\.(py|cfg)|package(-lock)?\.json|pnpm-lock\.yaml|yarn\.lock|Cargo\.toml|go\.mod|Gemfile|pom\.xml|build\.gradle(\.kts)?|[^/]*\.csproj)$"


_DEPENDENCY = "name string, spec string, line int, pin string, ecosystem string"


def included_requirements(files: DataFrame, depth: int = 8) -> DataFrame:
    """Files that requirement files include (``-r``), directly or by others, and
    that aren't manifests by their own name.  Each is visited once; what a round finds
    is stored, so the next one doesn't find it anew."""
    here = files.select("root", "path", "content")
    seen = here.where(F.col("path").rlike(r"(^|/)requirements[^/]*\.txt$"))
    now, out = seen, here.limit(0)
    for _ in range(depth):
        line = F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^\s*(?:-r|--requirement)\s+(\S+)"), F.lit(1)))
        asked = now.select("root", F.regexp_replace("path", "[^/]*$", "").alias("dir"), line.alias("to"))
        asked = asked.select("root", normal_path(F.concat("dir", "to")).alias("path")).distinct().join(seen.select("root", "path"), ["root", "path"], "left_anti")
        now = stored(here.join(asked.hint("merge"), ["root", "path"], "left_semi"))
        if now.isEmpty():
            break
        out, seen = out.unionByName(now), seen.select("root", "path", "content").unionByName(now)
    return out.where(~F.col("path").rlike(MANIFESTS))


def manifests(files: DataFrame, includes: bool = True) -> DataFrame:
    """Dependencies of manifests, and of what requirement files include."""
    own = files.select("root", "path", "content").where(F.col("path").rlike(MANIFESTS))
    found = parsed(own, parse_manifest, _DEPENDENCY)
    if not includes:
        return found
    return found.unionByName(parsed(included_requirements(files), lambda root, path, content: parse_manifest(root, "requirements.txt", content), _DEPENDENCY))


def parse_local_deps(root: str, path: str, content: str):
    """name, target, kind, escapes of git and path dependencies."""
    import posixpath

    name, here = path.rsplit("/", 1)[-1], path.rpartition("/")[0]
    found = []
    if name == "pyproject.toml":
        doc = tomllib.loads(content).get("tool", {})
        for k, v in {**doc.get("uv", {}).get("sources", {}), **doc.get("poetry", {}).get("dependencies", {})}.items():
            if isinstance(v, dict):
                found += [(k, v[s], s) for s in ("git", "path") if s in v]
    elif re.match(r"requirements.*\.txt$", name):
        for m in re.finditer(r"(?m)^\s*(?:-e\s+)?(?:([\w.-]+)\s*@\s*)?(git\+\S+|\.{1,2}/\S*)", content):
            found.append((m[1] or m[2].rstrip("/").rsplit("/", 1)[-1], m[2].removeprefix("git+"), "git" if m[2].startswith("git") else "path"))
    elif name == "package.json":
        doc = json.loads(content)
        for k, v in {**(doc.get("dependencies") or {}), **(doc.get("devDependencies") or {})}.items():
            if re.match(r"(git\+|github:|file:|link:)", v):
                found.append((k, re.sub(r"^(git\+|file:|link:)", "", v), "path" if re.match("file:|link:", v) else "git"))
    elif name == "go.mod":
        for m in re.finditer(r"(?m)^\s*(?:replace\s+)?(\S+)(?:\s+v\S+)?\s*=>\s*(\S+)", content):
            found.append((m[1], m[2], "path" if m[2].startswith(".") else "git"))
    for k, target, kind in found:
        place = posixpath.normpath(posixpath.join(here, target)) if kind == "path" else target
        yield k, place, kind, kind == "path" and (place.startswith("..") or place.startswith("/"))


def local_dependencies(files: DataFrame) -> DataFrame:
    return parsed(files.where(F.col("path").rlike(MANIFESTS)), parse_local_deps, "name string, target string, kind string, escapes_root boolean")


# --- documents with a known shape ------------------------------------------


def n8n_nodes(files: DataFrame) -> DataFrame:
    """AI nodes of workflow files."""
    nodes = F.from_json("content", "struct<nodes:array<struct<name:string,type:string,parameters:struct<model:string>>>>")["nodes"]
    one = files.where(extension() == ".json").where(F.col("content").contains('"nodes"')).select("root", "path", F.explode(nodes).alias("n"))
    kind = F.when(F.col("n.type").rlike("(?i)agent"), "agent").when(F.col("n.type").rlike("(?i)vectorstore"), "vector_store").when(F.col("n.type").rlike("(?i)embedding"), "embedding").when(F.col("n.type").rlike("(?i)memory"), "memory").when(F.col("n.type").rlike("(?i)lmchat|openai|model"), "model").when(F.col("n.type").rlike("(?i)tool"), "tool")
    return one.select("root", "path", F.col("n.name").alias("name"), kind.alias("component_type"), F.col("n.parameters.model").alias("model_name")).where("component_type is not null")


def mcp_servers(files: DataFrame) -> DataFrame:
    """Servers of client configurations, with transport."""
    def parse(root, path, content):
        doc = json.loads(content)
        for k, v in (doc.get("mcpServers") or doc.get("servers") or {}).items():
            url = str(v.get("url") or "")
            kind = v.get("transport") or v.get("type") or ("streamable-http" if "streamable" in url else "sse" if url else "stdio")
            yield k, url, kind, str(v.get("command") or "")

    own = files.where(F.col("path").rlike(r"(^|/)(\.?mcp\.json|mcp_config\.json|claude_desktop_config\.json|mcp-servers\.json|settings\.json)$") & F.col("content").rlike("(?i)servers"))
    return parsed(own, parse, "name string, url string, transport string, command string")


def agent_cards(files: DataFrame) -> DataFrame:
    """Agent cards by place or shape; security schemes by name alone."""
    def parse(root, path, content):
        doc = json.loads(content)
        known = path.endswith((".well-known/agent.json", ".well-known/agent-card.json"))
        shape = isinstance(doc, dict) and "name" in doc and sum(k in doc for k in ("skills", "capabilities", "url", "protocolVersion", "defaultInputModes")) >= 2
        if known or shape:
            urls = [doc.get("url")] + [i.get("url") for i in doc.get("additionalInterfaces") or []]
            yield str(doc.get("name") or path), [u for u in urls if u], [str(s.get("name") or s.get("id")) for s in doc.get("skills") or []], sorted(doc.get("securitySchemes") or {}), "well_known" if known else "shape"

    own = files.where((extension() == ".json") & (F.length("content") <= 1_000_000) & F.col("content").contains('"name"'))
    return parsed(own, parse, "name string, endpoints array<string>, skills array<string>, security array<string>, reason string")


def ci_components(files: DataFrame) -> DataFrame:
    """AI images and steps, and secrets' names, of CI files."""
    def parse(root, path, content):
        for i, line in enumerate(content.splitlines(), 1):
            if m := re.search(r"secrets\.([A-Z0-9_]*(?:OPENAI|ANTHROPIC|HF|HUGGING|COHERE|AZURE)[A-Z0-9_]*)", line):
                yield m[1], "secret", i
            if m := re.search(r"(?:uses|image):\s*[\"']?(\S*(?:openai|anthropic|huggingface|ollama|vllm|claude|pytorch|tensorflow)[^\s\"']*)", line):
                yield m[1], "tool" if "uses:" in line else "dependency", i

    return parsed(files.where(F.col("path").rlike(r"(^|/)(\.github/workflows/[^/]+\.ya?ml|\.gitlab-ci\.ya?ml)$")), parse, "name string, component_type string, line int")


# Cloud resources that hold AI assets.
RESOURCES = {"aws_sagemaker_model": "model", "aws_sagemaker_endpoint": "model_endpoint", "aws_bedrock_custom_model": "model", "aws_bedrockagent_agent": "agent", "aws_bedrockagent_knowledge_base": "knowledge_base", "google_vertex_ai_endpoint": "model_endpoint", "google_vertex_ai_index": "vector_store", "azurerm_cognitive_deployment": "model_endpoint", "azurerm_machine_learning_workspace": "ml_pipeline", "AWS::SageMaker::Model": "model", "AWS::SageMaker::Endpoint": "model_endpoint", "AWS::Bedrock::Agent": "agent", "AWS::Bedrock::Guardrail": "guardrail", "Microsoft.CognitiveServices/accounts": "model_endpoint", "Microsoft.MachineLearningServices/workspaces": "ml_pipeline"}


def cloud_resources(files: DataFrame) -> DataFrame:
    """AI resources of Terraform, CloudFormation, ARM and Bicep files."""
    def parse(root, path, content):
        at = lambda m: content.count("\n", 0, m.start()) + 1
        if path.endswith(".tf"):
            for m in re.finditer(r'(?m)^\s*resource\s+"([^"]+)"\s+"([^"]+)"', content):
                if m[1] in RESOURCES:
                    yield m[2], RESOURCES[m[1]], m[1], at(m)
        elif path.endswith(".bicep"):
            for m in re.finditer(r"(?m)^\s*resource\s+(\w+)\s+'([^@']+)@", content):
                if m[2] in RESOURCES:
                    yield m[1], RESOURCES[m[2]], m[2], at(m)
        else:
            doc = json.loads(content) if path.endswith(".json") else next(iter(yaml_documents(re.sub(r"!(\w+)", "", content))), {})
            resources = doc.get("Resources") if isinstance(doc, dict) else None
            for k, v in (resources or {}).items():
                if v.get("Type") in RESOURCES:
                    yield k, RESOURCES[v["Type"]], v["Type"], 0
            for v in (doc.get("resources") if isinstance(doc, dict) else None) or []:
                if v.get("type") in RESOURCES:
                    yield str(v.get("name")), RESOURCES[v["type"]], v["type"], 0

    return parsed(files.where(F.col("path").rlike(r"\.(tf|bicep|json|ya?ml)$") & F.col("content").rlike("|".join(["(?i)resource"]))), parse, "name string, component_type string, resource string, line int")


# Formats of model files by extension.
MODEL_FORMATS = {".safetensors": "safetensors", ".gguf": "gguf", ".onnx": "onnx", ".pt": "pytorch", ".pth": "pytorch", ".bin": "pytorch", ".h5": "tensorflow", ".pb": "tensorflow", ".tflite": "tflite", ".keras": "keras", ".mlmodel": "coreml"}
#: Bytes of a header that is read.
HEADER = 10 * 1024 * 1024


def model_headers(files: DataFrame) -> DataFrame:
    """Model files with their format and what their first bytes say: verified
    (safetensors with a header of JSON, GGUF and ONNX with their magic), the GGUF
    version, and the length of a safetensors header (null beyond ``HEADER``)."""
    ext, raw = extension(), F.col("raw")
    kind = F.lit(None).cast("string")
    for e, name in MODEL_FORMATS.items():
        kind = F.when(ext == e, name).otherwise(kind)
    number = lambda at, n: F.conv(F.concat(*(F.hex(F.substring(raw, at + i, 1)) for i in reversed(range(n)))), 16, 10).cast("decimal(20,0)")
    size = F.when((kind == "safetensors") & (F.length(raw) >= 8), number(1, 8))
    size = F.when(size <= HEADER, size.cast("long"))
    magic = F.hex(F.substring(raw, 1, 4))
    verified = F.when(kind == "safetensors", F.coalesce(F.hex(F.substring(raw, 9, 1)) == "7B", F.lit(False)) & size.isNotNull()).when(kind == "gguf", magic == "47475546").when(kind == "onnx", (F.length(raw) >= 2) & magic.startswith("08"))
    version = F.when((kind == "gguf") & (magic == "47475546") & (F.length(raw) >= 8), number(5, 4).cast("long"))
    return files.select("root", "path", kind.alias("format"), F.coalesce(verified, F.lit(False)).alias("verified"), version.alias("version"), size.alias("header_bytes")).where("format is not null")


def binary_assets(files: DataFrame) -> DataFrame:
    """Model and data files by their first bytes, with a confidence."""
    text, ext = F.upper(F.hex(F.substring(F.col("raw"), 1, 16))), extension()
    begins = lambda s: text.startswith(s.encode().hex().upper())
    first = F.split_part(F.col("content"), F.lit("\n"), F.lit(1))
    table = F.size(F.filter(F.split(first, F.when(ext == ".tsv", "\t").otherwise(",")), lambda x: F.trim(x) != "")) >= 2
    kind = F.when((ext == ".parquet") & begins("PAR1"), "dataset").when(ext.isin(".arrow", ".feather") & begins("ARROW1"), "dataset").when(ext.isin(".csv", ".tsv") & table, "dataset").when((ext == ".jsonl") & first.rlike(r"^\s*\{.*\}\s*$"), "dataset").when(ext == ".tfrecord", "dataset")
    data = files.select("root", "path", kind.alias("component_type"), F.when(ext == ".tfrecord", 0.7).otherwise(0.9).alias("confidence")).where("component_type is not null")
    # What has a magic must show it; other formats go by their name, less surely.
    checked = F.col("format").isin("safetensors", "gguf", "onnx")
    models = model_headers(files).where(F.col("verified") | ~checked).select("root", "path", F.lit("model_artifact").alias("component_type"), F.when(checked, 0.9).otherwise(0.7).alias("confidence"))
    return data.unionByName(models).withColumn("name", F.element_at(F.split("path", "/"), -1))


def load_custom_catalogue(text: str) -> dict:
    """Components, base classes, excludes and relationship hints of a custom
    catalogue in YAML or JSON; entries without id or concept are left out."""
    doc = (yaml_documents(text) or [{}])[0]
    return {
        "components": [c for c in doc.get("components") or [] if c.get("id") and c.get("concept")],
        "base_classes": [b for b in doc.get("base_classes") or [] if b.get("base_class") and b.get("concept")],
        "excludes": [str(x) for x in doc.get("excludes") or []], "relationship_hints": doc.get("relationship_hints") or {},
        "custom_relationships": doc.get("custom_relationships") or [],
    }


def merge_catalogue(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing rows win over new ones of the same id."""
    return existing.unionByName(new.join(existing.select("id"), "id", "left_anti").dropDuplicates(["id"]).select(*existing.columns))


def graph_configs(files: DataFrame) -> DataFrame:
    """Agents and embeddings of graph configurations (langgraph.json): each graph
    with its entry point, and the model of the store's index with its size."""
    shape = "struct<graphs:map<string,string>,store:struct<index:struct<embed:string,dims:string>>>"
    own = files.where(F.col("path").rlike(r"(^|/)langgraph\.json$")).select("root", "path", F.from_json("content", shape).alias("c")).where("c is not null")
    graphs = own.select("root", "path", F.explode("c.graphs").alias("name", "detail")).select("root", "path", "name", F.lit("agent").alias("component_type"), "detail")
    index = own.where("coalesce(c.store.index.embed, '') <> ''").select("root", "path", F.col("c.store.index.embed").alias("name"), F.lit("embedding").alias("component_type"), F.col("c.store.index.dims").alias("detail"))
    return graphs.unionByName(index)


def repositories_below(files: DataFrame, depth: int = 3) -> DataFrame:
    """Directories that hold a ``.git``, at most so deep below their root; none
    below another one, and none in directories that hold dependencies."""
    skipped = (".git", "node_modules", ".venv", "venv", "__pycache__")
    git = F.regexp_extract("path", r"^(|.*?/)\.git(?:/|$)", 1)
    held = files.where(F.col("path").rlike(r"(^|/)\.git(/|$)")).select("root", F.regexp_replace(git, "/$", "").alias("dir")).distinct()
    parts = F.filter(F.split("dir", "/"), lambda x: x != "")
    near = held.where((F.size(parts) <= depth) & ~F.exists(parts, lambda x: x.isin(*skipped)))
    above = near.select("root", "dir", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))), lambda i: F.concat_ws("/", F.slice(parts, 1, i)))).alias("up")).where("up <> dir")
    inner = above.join(near.select("root", F.col("dir").alias("up")), ["root", "up"]).select("root", "dir").distinct()
    return near.join(inner, ["root", "dir"], "left_anti")


def repository_list(text: str) -> list[str]:
    """Repositories of a list: a JSON array, or lines without blanks and comments."""
    text = text.strip()
    if text.startswith("["):
        try:
            return [str(e).strip() for e in json.loads(text) if str(e).strip()]
        except ValueError:
            pass
    return [x.strip() for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]


def ignore_rules(files: DataFrame, name: str = ".assetignore") -> list[str]:
    """The patterns of the first root that has an ignore file of that name.
    A pattern after ! takes a path back."""
    rows = files.where(F.col("path") == name).orderBy("root").select("content").limit(1).collect()
    return ignore_lines(rows[0]["content"]) if rows else []


def without_ignored(files: DataFrame, rules: list[str]) -> DataFrame:
    """Files that the last rule that matches them doesn't exclude."""
    out = F.lit(False)
    for rule in rules:
        back = rule.startswith("!")
        out = F.when(F.col("path").rlike(_glob(rule.removeprefix("!"))), F.lit(not back)).otherwise(out)
    return files.where(~out)


_SPACE = re.compile(r"[ \t\n\r]*")
_DECODE = json.JSONDecoder().raw_decode


def _after(text: str, at: int) -> tuple[str, int]:
    """The next character that isn't white space, and its place."""
    at = _SPACE.match(text, at).end()
    return text[at : at + 1], at


def _next(text: str, at: int, end: str) -> tuple[bool, int]:
    """Whether a list or object goes on after a member, and the place behind what says so."""
    mark, at = _after(text, at)
    if mark not in (",", end) or not mark:
        raise ValueError("not JSON")
    return mark == ",", at + 1


def _items(text: str, at: int) -> Iterator[tuple[int, object]]:
    """(place behind it, item) of a list, one decoded at a time; at last the list's end and None."""
    mark, begin = _after(text, at + 1)
    more, at = mark != "]", begin + (mark == "]")
    while more:
        item, at = _DECODE(text, _after(text, at)[1])
        yield at, item
        more, at = _next(text, at, "]")
    yield at, None


def _outline(text: str, at: int, depth: int) -> tuple[int, tuple[int, dict | None]]:
    """The end of a value, its place, and of an object its members' outlines to a
    depth.  What lies in lists is decoded to be checked and let go."""
    mark, begin = _after(text, at)
    if mark == "[":
        for at, _ in _items(text, begin):
            pass
        return at, (begin, None)
    if mark != "{" or not depth:
        return _DECODE(text, begin)[1], (begin, None)
    members: dict[str, tuple] = {}
    mark, at = _after(text, begin + 1)
    more, at = mark != "}", at + (mark == "}")
    while more:
        mark, at = _after(text, at)
        if mark != '"':
            raise ValueError("not JSON")
        key, at = _DECODE(text, at)
        mark, at = _after(text, at)
        if mark != ":":
            raise ValueError("not JSON")
        at, members[key] = _outline(text, at + 1, depth - 1)
        more, at = _next(text, at, "}")
    return at, (begin, members)


def _report(text: str) -> Iterator[tuple]:
    """A report's components, one at a time."""
    end, (_, top) = _outline(text, 0, 4)
    if top is None or _after(text, end)[0]:
        raise ValueError("not a report")
    value = lambda node: _DECODE(text, node[0])[0]
    sources = top.get("sources")
    if sources and sources[1] is None and value(sources):
        raise TypeError("sources are no object")
    for key, (_, src) in ((sources and sources[1]) or {}).items():
        if src is None:
            raise TypeError("a source is no object")
        source = str(("source_path" in src and value(src["source_path"])) or key)
        held = src.get("components", (0, src))
        for kind, (place, members) in held[1].items() if held[1] is not None else [(None, held)]:
            rows = members if members is not None else (r for _, r in _listed(text, place)) if text[place] == "[" else value((place, None))
            for r in rows:
                yield source, r.get("component_type") or kind, r.get("name"), r.get("file_path") or "", int(r.get("line_number") or 0), r.get("model_name")


def _listed(text: str, at: int) -> Iterator[tuple[int, object]]:
    """``_items`` without the end."""
    held = None
    for now in _items(text, at):
        if held is not None:
            yield held
        held = now


_ROWS = 10_000


def read_reports(reports: DataFrame) -> DataFrame:
    """Components of written reports (report, content as JSON): source, type,
    name, file_path, line_number, model_name and ord, whether they stand by type
    or in one list.  A report may be large, so beside its text no more than a batch of
    its components is held: it is read once to see that all of it can be, and once more
    to give its rows."""
    kind = StructType.fromDDL("report string, source string, component_type string, name string, file_path string, line_number int, model_name string, ord int")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for report, content in zip(batch["report"], batch["content"], strict=True):
                report, content = report.as_py(), content.as_py() or ""
                try:
                    for _ in _report(content):
                        pass
                except UNREAD:
                    continue
                found = enumerate(_report(content))
                while rows := [(report, *r, i) for i, r in islice(found, _ROWS)]:
                    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(arrow)], schema=arrow)

    own = reports.select("report", "content")
    return own.repartition(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), "report").mapInArrow(run, kind).hint("merge")


def infrastructure_names(files: DataFrame) -> DataFrame:
    """What infrastructure files define: Terraform variables with a default and
    locals, CloudFormation parameters and resources, ARM parameters, and values
    of Helm by path: kind, name, value (null without one)."""
    def leaves(node, at=""):
        if isinstance(node, dict):
            for k, v in node.items():
                yield from leaves(v, f"{at}.{k}" if at else str(k))
        elif not isinstance(node, list):
            yield at, None if node is None else str(node)

    def parse(root, path, content):
        name = path.rsplit("/", 1)[-1]
        if name.endswith(".tf"):
            for m in re.finditer(r'variable\s+"([^"]+)"\s*\{([^}]*)\}', content):
                told = re.search(r'default\s*=\s*"([^"]*)"', m[2])
                if told:
                    yield "terraform_variable", m[1], told[1]
            for block in re.finditer(r"locals\s*\{([^}]*)\}", content):
                for m in re.finditer(r'(?m)^\s*(\w+)\s*=\s*"([^"]*)"', block[1]):
                    yield "terraform_local", m[1], m[2]
        elif name in ("values.yaml", "values.yml"):
            for doc in yaml_documents(content):
                yield from (("helm_value", k, v) for k, v in leaves(doc))
        else:
            doc = json.loads(content) if name.endswith(".json") else next(iter(yaml_documents(re.sub(r"!(\w+)", "", content))), {})
            if isinstance(doc, dict) and ("Resources" in doc or "AWSTemplateFormatVersion" in doc):
                for k, v in (doc.get("Parameters") or {}).items():
                    yield "cloudformation_parameter", k, None if v.get("Default") is None else str(v["Default"])
                for k, v in (doc.get("Resources") or {}).items():
                    yield "cloudformation_resource", k, str(v.get("Type") or "")
            elif isinstance(doc, dict) and "deploymentTemplate" in str(doc.get("$schema")):
                for k, v in (doc.get("parameters") or {}).items():
                    yield "arm_parameter", k, None if v.get("defaultValue") is None else str(v["defaultValue"])

    return parsed(files.where(F.col("path").rlike(r"\.(tf|json|ya?ml)$")), parse, "kind string, name string, value string")


def infrastructure_reference(names: DataFrame, expression: str, kind: str) -> DataFrame:
    """What an expression refers to, by the first definition in order of place:
    var.x and local.x, a logical id, a parameter's name, a path of values.  What
    a module defines is never known."""
    kinds = {"terraform": {"var": "terraform_variable", "local": "terraform_local"}, "cloudformation": ("cloudformation_parameter", "cloudformation_resource"), "arm": ("arm_parameter",), "helm": ("helm_value",)}[kind]
    name, wanted = expression.strip(), kinds
    if kind == "terraform":
        head, _, name = expression.strip().partition(".")
        wanted = (kinds[head],) if head in kinds else ()
    if kind == "helm":
        name = name.strip("{} ").removeprefix(".Values.").removeprefix("Values.")
    return names.where(F.col("kind").isin(*wanted) & (F.col("name") == name)).orderBy(F.col("value").isNull(), "root", "path", "ord").limit(1) if wanted else names.limit(0)
