"""Evidence that a class is an agent: what is known of frameworks, protocols and
of things that are no agents (signatures), met with what classes do.

Signatures are rows, one for each needle.  Names meet needles by dotted suffixes
in both directions (``agents.Agent`` and ``crewai.agents.Agent``, or ``Agent``),
an equi-join of suffixes; what must only be contained is looked for by all
needles at once.  What stands in a class is found by the index of spans."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inventra.operators.extract import dotted, python_files
from inventra.operators.joins import suffixes
from inventra.operators.spans import first_around, stabbed
from inventra.sources.files import parsed

# The signatures that are known.  Frameworks by id, framework and pattern, with the entry points that are called,
# base classes, and imports of which a file must have one.
FRAMEWORKS = (
    {"id": "langchain.AgentExecutor", "framework": "langchain", "evidence_pattern": "framework_agent", "entrypoint_qualified_names": ["langchain.agents.AgentExecutor", "langchain.agents.AgentExecutor.from_agent_and_tools", "langchain_core.agents.AgentExecutor", "AgentExecutor"], "import_substrings": ["langchain.agents", "langchain_core.agents"]},
    {"id": "langchain.BaseSingleActionAgent", "framework": "langchain", "evidence_pattern": "framework_inheritance", "base_class_names": ["BaseSingleActionAgent", "BaseMultiActionAgent", "langchain.agents.BaseSingleActionAgent", "langchain.agents.BaseMultiActionAgent"], "import_substrings": ["langchain.agents"]},
    {"id": "langgraph.create_react_agent", "framework": "langgraph", "evidence_pattern": "framework_agent", "entrypoint_qualified_names": ["langgraph.prebuilt.create_react_agent", "create_react_agent"], "import_substrings": ["langgraph.prebuilt", "langgraph"]},
    {"id": "autogen.AssistantAgent", "framework": "autogen", "evidence_pattern": "framework_agent", "entrypoint_qualified_names": ["autogen.AssistantAgent", "autogen.UserProxyAgent", "autogen_agentchat.agents.AssistantAgent", "AssistantAgent", "UserProxyAgent"], "import_substrings": ["autogen", "autogen_agentchat"]},
    {"id": "crewai.Agent", "framework": "crewai", "evidence_pattern": "framework_agent", "entrypoint_qualified_names": ["crewai.Agent", "Agent"], "import_substrings": ["crewai"]},
    {"id": "llama_index.ReActAgent", "framework": "llama_index", "evidence_pattern": "framework_agent", "entrypoint_qualified_names": ["llama_index.core.agent.ReActAgent", "llama_index.agent.ReActAgent", "ReActAgent"], "import_substrings": ["llama_index"]},
    {"id": "llama_index.BaseAgent", "framework": "llama_index", "evidence_pattern": "framework_inheritance", "base_class_names": ["BaseAgent", "llama_index.core.agent.BaseAgent"], "import_substrings": ["llama_index"]},
    {"id": "openai_agents.Agent", "framework": "openai_agents", "evidence_pattern": "framework_agent", "entrypoint_qualified_names": ["agents.Agent"], "import_substrings": ["agents.run", "agents.agent"]},
    {"id": "pydantic_ai.Agent", "framework": "pydantic_ai", "evidence_pattern": "framework_agent", "entrypoint_qualified_names": ["pydantic_ai.Agent"], "import_substrings": ["pydantic_ai"]},
    {"id": "haystack.Agent", "framework": "haystack", "evidence_pattern": "framework_agent", "entrypoint_qualified_names": ["haystack.agents.Agent", "haystack_experimental.core.Agent"], "import_substrings": ["haystack.agents", "haystack_experimental"]},
    {"id": "strands.Agent", "framework": "strands", "evidence_pattern": "framework_agent", "entrypoint_qualified_names": ["strands.Agent", "strands.agent.Agent", "Agent"], "import_substrings": ["strands"]},
    {"id": "strands.experimental.BidiAgent", "framework": "strands", "evidence_pattern": "framework_agent", "entrypoint_qualified_names": ["strands.experimental.bidi.BidiAgent", "strands.experimental.BidiAgent", "BidiAgent"], "import_substrings": ["strands.experimental.bidi", "strands.experimental"]},
)
# Protocols, by what calls' names or texts contain; an import is no condition.
PROTOCOLS = (
    {"id": "a2a.server", "protocol": "a2a", "evidence_pattern": "a2a_server", "role": "server", "qualified_name_substrings": ["A2AServer"], "string_literal_substrings": [".well-known/agent.json"]},
    {"id": "a2a.client", "protocol": "a2a", "evidence_pattern": "remote_proxy", "role": "client", "qualified_name_substrings": ["A2AClient"], "string_literal_substrings": ["message/send", "message/stream", "tasks/get"]},
    {"id": "mcp.server", "protocol": "mcp", "evidence_pattern": "other", "role": "server", "qualified_name_substrings": ["FastMCP"], "string_literal_substrings": ["tools/list", "resources/list", "prompts/list"]},
    {"id": "mcp.client", "protocol": "mcp", "evidence_pattern": "other", "role": "client", "qualified_name_substrings": ["ClientSession"], "string_literal_substrings": ["tools/call"]},
    {"id": "openai.assistants", "protocol": "openai_assistants", "evidence_pattern": "remote_proxy", "role": "client", "qualified_name_substrings": ["client.beta.assistants.create", "client.beta.threads.runs.create", "openai.beta.assistants", "openai.beta.threads.runs"], "string_literal_substrings": ["/v1/assistants", "/v1/threads"]},
)
# What is no agent whatever else it does.
ANTI_PATTERNS = (
    {"id": "temporal.workflow", "label": "temporal_workflow", "decorator_qualified_names": ["temporalio.workflow.defn", "workflow.defn"], "import_substrings": ["temporalio.workflow"]},
    {"id": "temporal.activity", "label": "temporal_activity", "decorator_qualified_names": ["temporalio.activity.defn", "activity.defn"], "import_substrings": ["temporalio.activity"]},
    {"id": "celery.task", "label": "celery_task", "decorator_qualified_names": ["celery.app.task.Task", "celery.Celery.task", "app.task", "celery_app.task"], "import_substrings": ["celery"]},
    {"id": "airflow.dag", "label": "airflow_dag", "base_class_names": ["BaseOperator", "airflow.models.BaseOperator", "airflow.operators.python.PythonOperator"], "decorator_qualified_names": ["airflow.decorators.dag", "dag"], "import_substrings": ["airflow"]},
    {"id": "fastapi.endpoint", "label": "fastapi_endpoint", "decorator_qualified_names": ["fastapi.APIRouter.get", "fastapi.APIRouter.post", "app.get", "app.post", "router.get", "router.post", "router.put", "router.delete", "router.patch"], "import_substrings": ["fastapi"]},
    {"id": "pydantic.basemodel", "label": "pydantic_basemodel", "base_class_names": ["BaseModel", "pydantic.BaseModel"], "import_substrings": ["pydantic"]},
)
# Libraries whose server runs the agent; a call's name ends so, a file imports one of these.
REMOTE_SDKS = (
    {"id": "openai.assistants", "sdk_name": "OpenAI Assistants API", "call_qualified_suffixes": [".threads.runs.create", ".threads.runs.create_and_stream", ".threads.runs.create_and_poll", ".threads.runs.stream", ".threads.runs.poll", ".threads.runs.submit_tool_outputs", ".threads.runs.submit_tool_outputs_stream"], "import_substrings": ["openai"]},
    {"id": "langgraph.cloud_sdk", "sdk_name": "LangGraph Cloud / LangGraph Platform SDK", "call_qualified_suffixes": [".runs.create", ".runs.stream", ".runs.wait", ".threads.runs.create", ".threads.runs.stream", ".threads.runs.wait"], "import_substrings": ["langgraph_sdk"]},
    {"id": "langgraph.remote_graph", "sdk_name": "LangGraph RemoteGraph", "call_qualified_suffixes": ["RemoteGraph"], "import_substrings": ["langgraph.pregel.remote"]},
    {"id": "aws.bedrock_agents", "sdk_name": "AWS Bedrock Agents Runtime (classic)", "call_qualified_suffixes": [".invoke_agent", ".invoke_agent_with_response_stream", ".invoke_inline_agent", ".invoke_flow"], "import_substrings": ["boto3", "botocore", "aiobotocore"]},
    {"id": "aws.bedrock_agentcore_runtime", "sdk_name": "AWS Bedrock AgentCore Runtime", "call_qualified_suffixes": [".invoke_agent_runtime"], "import_substrings": ["boto3", "botocore", "aiobotocore"]},
    {"id": "gcp.vertex_reasoning_engines", "sdk_name": "Vertex AI Reasoning Engines", "call_qualified_suffixes": ["ReasoningEngine"], "import_substrings": ["vertexai.preview.reasoning_engines", "vertexai.reasoning_engines"]},
)
KNOWN = {"frameworks": FRAMEWORKS, "protocols": PROTOCOLS, "anti_patterns": ANTI_PATTERNS, "remote_agent_sdks": REMOTE_SDKS}
# A loop's least calls and different callees; what a model's call is named by; the best pattern first.
POLICY = {"min_react_loop_call_count": 2, "min_react_loop_distinct_callees": 3}
MODEL_CALLS = ("invoke", "ainvoke", "chat.completion", "chat_completion", "messages.create", "responses.create", ".llm.call", "llm_call", "llm_invoke", "acomplet")
PATTERNS = ("framework_agent", "framework_inheritance", "a2a_server", "react_loop", "remote_proxy", "other")

#: Kind, and what an entry must have and may have, and the surface of each list.
_KINDS = {
    "frameworks": ("framework", ("id", "evidence_pattern"), "framework"), "protocols": ("protocol", ("id", "protocol", "evidence_pattern"), "protocol"),
    "anti_patterns": ("anti", ("id", "label"), "label"), "remote_agent_sdks": ("remote", ("id", "call_qualified_suffixes"), "sdk_name"),
}
_SURFACES = {"entrypoint_qualified_names": "entry", "base_class_names": "base", "import_substrings": "import", "qualified_name_substrings": "part", "string_literal_substrings": "text", "decorator_qualified_names": "decorator", "call_qualified_suffixes": "end"}


def _words(value) -> list[str]:
    return [] if value is None else [value] if isinstance(value, str) else [str(v) for v in value if v is not None] if isinstance(value, (list, tuple)) else []


def merged(user: dict | None) -> dict[str, dict[str, dict]]:
    """The known signatures with a user's by list and id: one of the same id takes
    the known one's place, others come after; entries without what they must have
    are left out."""
    out = {}
    for group, (_, must, _) in _KINDS.items():
        held = {s["id"]: s for s in KNOWN[group]}
        given = (user or {}).get(group) if isinstance(user, dict) else None
        for s in given if isinstance(given, list) else ():
            good = isinstance(s, dict) and all(_words(s.get(m)) if m == "call_qualified_suffixes" else s.get(m) and isinstance(s.get(m), str) for m in must)
            if good:
                held[s["id"]] = s
        out[group] = held
    return out


def policy(user: dict | None) -> dict[str, int]:
    given = (user or {}).get("verification_policy") if isinstance(user, dict) else None
    return POLICY | {k: int(v) for k, v in given.items() if k in POLICY} if isinstance(given, dict) else POLICY


def needles(user: dict | None = None) -> list[tuple]:
    """(kind, signature, label, pattern, role, narrow, surface, needle, n): one for
    each needle, n its place; narrow: a file must have one of its imports."""
    rows = []
    for group, held in merged(user).items():
        kind, _, label = _KINDS[group]
        for s in held.values():
            narrow = kind != "protocol" and bool(_words(s.get("import_substrings")))
            told = kind, s["id"], str(s.get(label) or ("custom" if kind == "framework" else s["id"])), str(s.get("evidence_pattern") or kind), str(s.get("role") or "unknown"), narrow
            rows += [(*told, surface, x, n) for name, surface in _SURFACES.items() for n, x in enumerate(_words(s.get(name))) if x]
    return rows


_NEEDLE = "sort string, signature string, label string, pattern string, role string, narrow boolean, surface string, needle string, n int"


def _is_protocol_text(value: str) -> bool:
    s = value.strip()
    if not s or len(value) > 500:
        return False
    if s.startswith(("http://", "https://", "ws://", "wss://")) or (s[0] == "/" and "/" in s[1:]):
        return True
    space, _, method = s.partition("/")
    begins = lambda x: bool(x) and (x[0] == "_" or x[0].isalpha())
    return begins(space) and begins(method) and all(c.isalnum() or c == "_" for c in space) and all(c.isalnum() or c in "_." for c in method)


FACTS = "kind string, line int, end int, name string, owner string, method string, branch boolean, names array<string>"
_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)


class _Reader:
    """Rows of one file; frames are what encloses a node, the innermost last."""

    def __init__(self, tree: ast.Module):
        self.rows, self.frames, self.alias = [], [], {}
        self.assigned = {id(n.value) for n in ast.walk(tree) if isinstance(n, ast.Assign)}
        for n in ast.walk(tree):
            if isinstance(n, ast.Import):
                self.alias.update({a.asname: a.name for a in n.names if a.asname})
                for a in n.names:
                    self._add("import", n.lineno, a.name)
            elif isinstance(n, ast.ImportFrom):
                module = "." * n.level + (n.module or "")
                names = [a.name for a in n.names if a.name != "*"]
                self.alias.update({a.asname or a.name: f"{module}.{a.name}" for a in n.names if a.name != "*"})
                # The statement as it reads, and each name with its module.
                for said in (f"from {module} import {', '.join(a.name for a in n.names)}", *(f"{module}.{x}" for x in names)):
                    self._add("import", n.lineno, said)
        for child in ast.iter_child_nodes(tree):
            self._visit(child)

    def _add(self, kind: str, line: int, name: str, end=None, owner=None, method=None, branch=None, names=None) -> None:
        self.rows.append((kind, line, end or line, name, owner, method, branch, names or []))

    def _named(self, node: ast.AST) -> str:
        """A dotted name with what an import says of its head."""
        name = dotted(node.func if isinstance(node, ast.Call) else node)
        head, dot, rest = name.partition(".")
        return self.alias.get(head, head) + dot + rest

    def _function(self) -> dict | None:
        """The innermost function, unless a lambda or a class lies between."""
        for f in reversed(self.frames):
            if f["kind"] != "loop":
                return f if f["kind"] == "function" else None
        return None

    def _in(self, frame: dict, nodes) -> dict:
        self.frames.append(frame)
        for n in nodes:
            self._visit(n)
        return self.frames.pop()

    def _class(self) -> str | None:
        return next((f["name"] for f in reversed(self.frames) if f["kind"] == "class"), None)

    def _visit(self, node: ast.AST) -> None:
        children = list(ast.iter_child_nodes(node))
        if isinstance(node, (ast.ClassDef, *_FUNCTION)):
            is_class = isinstance(node, ast.ClassDef)
            for d in node.decorator_list:
                self._visit(d)
                if not is_class and self._named(d):
                    self._add("decorator", d.lineno, self._named(d))
            if is_class:
                outer = [f["name"] for f in self.frames if f["kind"] in ("class", "function")]
                self._add("class", node.lineno, node.name, node.end_lineno, ".".join([*outer, node.name]), names=[b for b in map(self._named, node.bases) if b])
                for d in node.decorator_list:
                    self._add("class_decorator", node.lineno, self._named(d))
            rest = [c for c in children if c not in node.decorator_list]
            self._in({"kind": "class" if is_class else "function", "name": node.name, "class": self._class(), "branches": 0}, rest)
        elif isinstance(node, ast.Lambda):
            self._in({"kind": "lambda", "name": ""}, children)
        elif isinstance(node, (ast.While, ast.For, ast.AsyncFor)):
            owner = self._function()
            before = owner["branches"] if owner else 0
            loop = {"kind": "loop", "name": "", "body": False, "calls": []}
            # What a loop tests or runs over isn't in its body.
            inner = {id(c) for c in (*node.body, *node.orelse)}
            self._in(loop, [c for c in children if id(c) not in inner])
            self._in(loop | {"body": True}, node.body)
            self._in(loop, node.orelse)
            if owner:
                kind = {ast.While: "while", ast.For: "for", ast.AsyncFor: "async for"}[type(node)]
                self._add("loop", node.lineno, kind, node.end_lineno, owner["class"], owner["name"], owner["branches"] > before, loop["calls"])
        else:
            for c in children:
                self._visit(c)
            self._told(node)

    def _told(self, node: ast.AST) -> None:
        """What a node says once all below it has been seen."""
        owner = self._function()
        if isinstance(node, ast.Call) and self._named(node):
            name = self._named(node)
            if owner:
                at = len(self.frames) - 1
                while self.frames[at]["kind"] == "loop":
                    if self.frames[at]["body"]:
                        self.frames[at]["calls"].append(name)
                    at -= 1
            self._add("assignment" if id(node) in self.assigned else "call", node.lineno, name)
        elif isinstance(node, (ast.If, ast.IfExp)) and owner:
            owner["branches"] += 1
        elif isinstance(node, ast.Constant) and isinstance(node.value, str) and _is_protocol_text(node.value) and (owner or self._class()):
            self._add("text", node.lineno, node.value, owner=owner["class"] if owner else self._class(), method=owner["name"] if owner else None)


def facts(files: DataFrame) -> DataFrame:
    """What Python files' classes, calls, decorators, loops, texts and imports are."""
    def parse(root: str, path: str, content: str) -> Iterator[tuple]:
        return iter(_Reader(ast.parse(content)).rows)

    return parsed(python_files(files), parse, FACTS)


def _same_name(rows: DataFrame, given: list[tuple]) -> DataFrame:
    """rows (with ``name`` and ``surface``) and the needles of their surface of which
    one is the other, or its end.  A needle is sent by its own name, and by each end
    of it for names that are no more than that, so that one join does."""
    ends = F.transform(suffixes(F.col("needle")), lambda s: F.struct(s.alias("_s"), (s != F.col("needle")).alias("_part")))
    sent = F.broadcast(rows.sparkSession.createDataFrame(given, _NEEDLE).select("*", F.inline(ends)))
    asked = F.transform(suffixes(F.col("name")), lambda s: F.struct(s.alias("_s"), (s == F.col("name")).alias("_whole")))
    return rows.where("name <> ''").select("*", F.inline(asked)).join(sent, ["_s", "surface"]).where("_whole or not _part").drop("_s", "_whole", "_part")


def _containing(rows: DataFrame, given: list[tuple]) -> DataFrame:
    """rows (with ``what`` and ``name``) and the needles that their name holds, or
    ends with; those of texts are for texts alone.  Needles are a few dozen rows of
    configuration; each name is tested against all at once."""
    fields = [x.split() for x in _NEEDLE.split(", ")]
    if not given:
        return rows.withColumns({f: F.lit(None).cast(kind) for f, kind in fields}).where(F.lit(False))
    held = F.array(*(F.struct(*(F.lit(v).alias(f) for (f, _), v in zip(fields, x, strict=True))) for x in given))

    def holds(x: Column) -> Column:
        fits = F.when(x["surface"] == "end", F.endswith(F.col("name"), x["needle"])).otherwise(F.contains(F.col("name"), x["needle"]))
        return ((x["surface"] == "text") == (F.col("what") == "text")) & fits

    met = rows.withColumn("_hit", F.explode(F.filter(held, holds)))
    return met.select(*rows.columns, *(F.col(f"_hit.{f}").alias(f) for f, _ in fields))


CLASS = ["root", "path", "class_name", "qualified_name", "class_start", "class_end"]


def classes(f: DataFrame) -> DataFrame:
    return f.where("kind = 'class'").select("root", "path", F.col("name").alias("class_name"), F.col("owner").alias("qualified_name"), F.col("line").alias("class_start"), F.col("end").alias("class_end"), F.col("names").alias("bases"))


#: What is said of a match, by its surface.
_SAYS = {"entry": "Call to framework entry point", "decorator": "Decorator", "part": "Protocol call", "text": "Protocol text", "end": "Remote agent call"}


def matches(f: DataFrame, user: dict | None = None) -> DataFrame:
    """CLASS, kind (framework, protocol, react_loop, anti, remote), signature,
    pattern, start_line, end_line, rationale: for each class and signature the
    first match by the signature's own order, and each loop over a model's calls.
    f: ``facts``, stored.  Facts meet needles before they meet classes, so one join
    of points and spans does for all rules, and what no rule asks for isn't in it."""
    given, least = needles(user), policy(user)
    of = lambda *surfaces: [x for x in given if x[6] in surfaces]
    held, what = classes(f).drop("bases"), F.col("what")
    told = f.withColumnRenamed("kind", "what")
    fact = ["root", "path", "line", "end", "ord", "what", "owner"]
    shown = ["sort", "signature", "label", "pattern", "narrow", "place", "line", "last", "rationale"]

    def place(first: Column | int, n: Column | int, later: Column | int) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(lit(first).alias("a"), lit(n).alias("b"), lit(later).alias("c"), F.col("line").alias("d"), F.col("ord").alias("e"))

    surface = F.col("surface")
    first = F.when(surface.isin("decorator", "text") | ((surface == "base") & (F.col("sort") == "framework")), 1).otherwise(0)
    later = F.when((what == "decorator") | ((what == "assignment") & surface.isin("entry", "part")), 1).otherwise(0)
    from_base = F.concat(F.lit("Class '"), F.col("class_name"), F.lit("' inherits from '"), F.col("needle"), F.lit("'"))
    said = F.concat(F.coalesce(*(F.when(surface == k, v) for k, v in _SAYS.items())), F.lit(" '"), F.col("name"), F.lit("' at line "), F.col("line").cast("string"))
    ranked = lambda df, said=said: df.withColumns({"place": place(first, F.col("n"), later), "last": F.col("line"), "rationale": said})

    asks = F.when(what == "class", "base").when(what.isin("decorator", "class_decorator"), "decorator").when(what.isin("call", "assignment"), "entry")
    names = F.when(what == "class", F.col("names")).otherwise(F.array("name"))
    named = told.select(*fact, F.col("name").alias("class_name"), asks.alias("surface"), F.explode(names).alias("name")).where("surface is not null")
    same = _same_name(named, [x for x in of("entry", "decorator", "base") if x[6] != "base" or x[0] in ("framework", "anti")])
    holding = ranked(_containing(told.where("what in ('call', 'assignment', 'text')").select(*fact, "name"), of("part", "text", "end")))

    distinct = F.size(F.array_distinct("names"))
    model = F.exists("names", lambda c: reduce(Column.__or__, [F.contains(F.lower(c), F.lit(x)) for x in MODEL_CALLS]))
    loops = told.where("what = 'loop'").where((F.size("names") >= least["min_react_loop_call_count"]) & (distinct >= least["min_react_loop_distinct_callees"]) & F.col("branch") & model)
    looped = F.format_string("%s loop in '%s' with %d calls, %d callees, a branch and a model's call", "name", "method", F.size("names"), distinct)
    loops = loops.withColumns({"sort": F.lit("react_loop"), "signature": F.lit("structural.react_loop"), "label": F.lit(None).cast("string"), "pattern": F.lit("react_loop"), "narrow": F.lit(False), "place": place(0, 0, 0), "last": F.col("end"), "rationale": looped})

    points = [x.select("root", "path", "what", "owner", *shown) for x in (ranked(same.where("what <> 'class'")), holding.where("surface <> 'end'"), loops)]
    inside = stabbed(reduce(DataFrame.unionByName, points), held, ["root", "path"], "line", "class_start", "class_end")
    # Texts and loops count for the class that they are the own of, its decorators for a class itself.
    inside = inside.where("(what not in ('text', 'loop') or owner = class_name) and (what <> 'class_decorator' or line = class_start)")
    ends = holding.where("surface = 'end'").select("root", "path", *shown)
    innermost = first_around(ends, held, ["root", "path"], "line", "class_start", "class_end", [-F.col("class_start"), F.col("class_end")], CLASS[2:], ends.columns).select(*ends.columns, "found.*")
    over = ranked(same.where("what = 'class'"), from_base).withColumns({"qualified_name": F.col("owner"), "class_start": F.col("line"), "class_end": F.col("end")})

    imports = _containing(told.where("what = 'import'").select("root", "path", "what", "name"), [x for x in of("import") if x[0] in ("framework", "anti", "remote")]).select("root", "path", "sort", "signature").distinct().withColumn("imported", F.lit(True))
    found = reduce(DataFrame.unionByName, [x.select(*CLASS, *shown) for x in (inside, innermost, over)])
    rows = found.join(imports, ["root", "path", "sort", "signature"], "left").where("imported or not narrow")
    each = F.when(F.col("sort") == "react_loop", F.col("place.e")).alias("each")
    best = rows.groupBy(*CLASS, "sort", "signature", each).agg(F.min(F.struct("place", "label", "pattern", "line", "last", "rationale")).alias("m"))
    pattern = F.when(F.col("sort") == "anti", F.col("m.label")).otherwise(F.col("m.pattern"))
    return best.select(*CLASS, F.col("sort").alias("kind"), "signature", pattern.alias("pattern"), F.col("m.line").alias("start_line"), F.col("m.last").alias("end_line"), "m.rationale")


def dossiers(f: DataFrame, user: dict | None = None) -> DataFrame:
    """CLASS, signatures (by kind and id), preferred (the best pattern), direct,
    proxy, excluded: one row for each class."""
    none = {c: F.lit(None).cast("string") for c in ("kind", "signature", "pattern")}
    # Classes that nothing is known of are rows without a match.
    m = matches(f, user).select(*CLASS, *none).unionByName(classes(f).select(*CLASS).withColumns(none))
    claims = F.col("kind").isin("framework", "protocol", "react_loop")
    rank = F.when(claims, F.coalesce(*(F.when(F.col("pattern") == p, i) for i, p in enumerate(PATTERNS))))
    flag = lambda c: F.coalesce(F.max(c), F.lit(False))
    grouped = m.groupBy(*CLASS).agg(
        F.array_sort(F.collect_set(F.when(F.col("kind").isNotNull(), F.concat_ws(":", "kind", "signature")))).alias("signatures"), F.min(rank).alias("_rank"),
        flag(F.col("kind").isin("framework", "react_loop") | ((F.col("kind") == "protocol") & (F.col("pattern") == "a2a_server"))).alias("direct"),
        flag((F.col("kind") == "protocol") & (F.col("pattern") == "remote_proxy")).alias("proxy"), flag(F.col("kind") == "anti").alias("excluded"),
    )
    best = F.coalesce(*(F.when(F.col("_rank") == i, p) for i, p in enumerate(PATTERNS)))
    return grouped.select(*CLASS, "signatures", best.alias("preferred"), "direct", "proxy", "excluded")


def agents(d: DataFrame) -> DataFrame:
    """The classes that are agents by their dossiers: with evidence of their own,
    and nothing that excludes them."""
    return d.where("direct and not excluded")
