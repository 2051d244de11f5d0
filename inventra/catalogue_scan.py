"""Queries of extraction: each part of the table is a file of a source tree, its
kind by the remainder of its key, and what scanners find follows from that."""

from __future__ import annotations

from pyspark.sql import functions as F

from inventra.catalogue import _t, query
from inventra.operators import anchors, derive, extract
from inventra.sources import files as S

_REQUIREMENTS = "openai==1.%d.0\nflask>=2\nLangChain_Core[all]>=0.1 ; x\n# c\n-r other.txt\ntorch # later\n"
_PYTHON = """import os
from langchain_openai import ChatOpenAI
# model = "commented-1"
MODEL_ID = "own-%d"
llm = ChatOpenAI(model=os.getenv("R%d_MODEL", "gpt-4o"), api_key=os.environ["OPENAI_API_KEY"])
cfg["model_name"] = 'claude-3-5-sonnet'
path = os.getenv("LOG_DIR")
spare = "gpt-4o-mini"
other = "nothing"
agent = Agent(name="a%d", tools=[llm])
"""
_ENV = "OPENAI_API_KEY='k%d'\nexport URL=https://h/%d\n# NO=1\nMODEL=gpt-%d # c\n"
_PACKAGE = '{"dependencies": {"openai": "4.%d.0", "left-pad": "^1"}, "devDependencies": {"ai": "~2"}}'
_SCRIPT = "import OpenAI from 'openai';\nconst token = process.env.ANTHROPIC_API_KEY;\n// process.env.OPENAI_API_KEY\nconst model = process.env['M%d'];\nimport x from './x%d';\n"
_SERVERS = '{"mcpServers": {"s%d": {"url": "https://h/streamable"}, "local": {"command": "npx"}}}'
_COMPOSE = "services:\n  web:\n    environment:\n      A%d: b\n      C: 1\n  db:\n    environment:\n      - D=e=%d\n"
_NOTEBOOK = '{"cells": [{"cell_type": "code", "source": ["%%pip x\\n", "model = \'nb-%d\'"]}, {"cell_type": "markdown", "source": "m"}, {"cell_type": "code", "source": "y = 1"}]}'
_BROKEN = "def x(:\n  model = 'no-%d'\n"
#: Path and content of each kind of file.
_FILES = (("requirements.txt", _REQUIREMENTS), ("a.py", _PYTHON), (".env", _ENV), ("package.json", _PACKAGE), ("web/app.ts", _SCRIPT), ("mcp.json", _SERVERS), ("docker-compose.yml", _COMPOSE), ("n.ipynb", _NOTEBOOK), ("b.py", _BROKEN), ("data.csv", "x%d,y\n1,2\n"))
_MORE = (("langgraph.json", '{"graphs": {"g%d": "./a.py:graph", "h": "b"}, "store": {"index": {"embed": "e-%d", "dims": 8}}}'), ("main.tf", 'variable "region" {\n  default = "r%d"\n}\nvariable "none" {\n}\nlocals {\n  model = "m%d"\n}\n'), ("values.yaml", "llm:\n  name: gpt-%d\n  list: [1]\nurl:\n"), ("stack.yaml", "AWSTemplateFormatVersion: x\nParameters:\n  P:\n    Default: d%d\n  Q: {}\nResources:\n  E:\n    Type: AWS::SageMaker::Endpoint\n"), (".git/HEAD", "x"), ("sub/.git/HEAD", "x"), ("a/b/c/d/.git/HEAD", "x"), (".assetignore", "# c\n*.log\n!keep.log\n/top%d\n"))
_DEEP = (("requirements.txt", "-r deps/base.in\nopenai==%d\n"), ("pnpm-lock.yaml", "packages:\n  /openai@4.%d.0:\n    x: 1\n  '@a/b@1.0(x)':\n    y: 1\n"), ("loop.py", "import a.b as c\nfrom .x import y\nz: T.U = 1\nclass R:\n    def run(self, llm):\n        while True:\n            o = llm.invoke(self.p())\n            if o.n%d:\n                return self.f(o)\n# asset: concept=agent\n"), ("w.gguf", "GGUF\x03"), ("m.onnx", "no"), ("k.keras", "x"))


def _tree(spark, d, kinds=_FILES):
    k, size, n = F.col("p_partkey"), F.col("p_size"), len(kinds)
    path = F.concat(F.lit("p"), k.cast("string"), F.lit("/"), F.element_at(F.array(*(F.lit(p) for p, _ in kinds)), (k % n + 1).cast("int")))
    content = F.lit("")
    for i, (_, text) in enumerate(kinds):
        # Numbers are filled in by hand, so that no kind needs as many arguments as another.
        whole = F.lit(text.replace("%%", "%"))
        content = F.when(k % n == i, F.replace(whole, F.lit("%d"), size.cast("string"))).otherwise(content)
    return _t(spark, d, "part").select(F.concat(F.lit("r"), (k % 3).cast("string")).alias("root"), path.alias("path"), content.alias("content"), F.lit(0).cast("long").alias("length"))


_P = "f as (select 'r' || (p_partkey % 3) as root, 'p' || p_partkey || '/' as dir, p_partkey % 10 as k, p_size as s from part)"


@query(f"""with {_P} select root, dir || 'requirements.txt' as path, unnest(['openai', 'flask', 'LangChain_Core', 'torch']) as name, unnest(['1.' || s || '.0', '2', '0.1', '*']) as spec, unnest([1, 2, 3, 6]) as line, unnest(['1.' || s || '.0', null, null, null]) as pin, 'pypi' as ecosystem from f where k = 0
union all select root, dir || 'package.json', unnest(['openai', 'left-pad', 'ai']), unnest(['4.' || s || '.0', '^1', '~2']), 1, unnest(['4.' || s || '.0', null, null]), 'npm' from f where k = 3""")
def scan_manifests(spark, d):
    return S.manifests(_tree(spark, d)).drop("ord")


@query(f"""with {_P}, n as (select root, dir || 'requirements.txt' as path, unnest(['openai', 'LangChain_Core', 'torch']) as name, unnest([1, 3, 6]) as line, 'pypi' as framework from f where k = 0 union all select root, dir || 'package.json', unnest(['openai', 'ai']), 1, 'npm' from f where k = 3),
r as (select *, row_number() over (partition by root, lower(name) order by path, line) as rn from n) select root, path, line, name, 'dependency' as component_type, framework, 0.95 as confidence, null as model_name, 'dependency' as scanner from r where rn = 1""")
def scan_dependencies(spark, d):
    return extract.SCANNERS["dependency"](_tree(spark, d))


@query(f"""with {_P} select root, dir || 'a.py' as path, unnest([4, 5, 6, 8]) as line, unnest(['own-' || s, 'gpt-4o', 'claude-3-5-sonnet', 'gpt-4o-mini']) as name, unnest([0.8, 0.8, 0.8, 0.6]) as confidence from f where k = 1 union all select root, dir || '.env', 4, 'gpt-' || s, 0.8 from f where k = 2 union all select root, dir || 'n.ipynb', 2, 'nb-' || s, 0.8 from f where k = 7""")
def scan_models(spark, d):
    return extract.SCANNERS["model"](_tree(spark, d)).select("root", "path", "line", "name", "confidence")


@query(f"""with {_P} select root, dir || 'a.py' as path, 5 as line, unnest(['env:R' || s || '_MODEL', 'env:OPENAI_API_KEY']) as name, unnest(['model', 'secret']) as component_type from f where k = 1 union all select root, dir || 'web/app.ts', unnest([2, 4]), unnest(['env:ANTHROPIC_API_KEY', 'env:M' || s]), unnest(['secret', 'model']) from f where k = 4""")
def scan_env_reads(spark, d):
    return extract.SCANNERS["env"](_tree(spark, d)).select("root", "path", "line", "name", "component_type")


@query(f"""with {_P} select root, dir || '.env' as path, unnest(['OPENAI_API_KEY', 'URL', 'MODEL']) as name, unnest(['k' || s, 'https://h/' || s, 'gpt-' || s || ' # c']) as value, unnest([1, 2, 4]) as line, 'dotenv' as source_type from f where k = 2 union all select root, dir || 'docker-compose.yml', unnest(['A' || s, 'C', 'D']), unnest(['b', '1', 'e=' || s]), 0, 'compose' from f where k = 6""")
def scan_env_index(spark, d):
    return S.env_index(_tree(spark, d)).drop("ord")


@query(f"""with {_P} select root, dir || 'web/app.ts' as path, 'openai' as name, 'npm' as framework, 1 as line from f where k = 4""")
def scan_imports(spark, d):
    return extract.SCANNERS["imports"](_tree(spark, d)).select("root", "path", "name", "framework", "line")


@query(f"""with {_P} select root, dir || 'mcp.json' as path, unnest(['s' || s, 'local']) as name, unnest(['https://h/streamable', '']) as url, unnest(['streamable-http', 'stdio']) as transport, unnest(['', 'npx']) as command from f where k = 5""")
def scan_mcp_servers(spark, d):
    return S.mcp_servers(_tree(spark, d)).drop("ord")


@query(f"""with {_P} select root, dir || 'n.ipynb' as path, '# MAGIC: %pip x' || chr(10) || 'model = ''nb-' || s || '''' || chr(10) || chr(10) || 'y = 1' as content from f where k = 7""")
def notebook_code(spark, d):
    return S.notebooks(_tree(spark, d)).select("root", "path", "content")


@query(f"""with {_P} select root, dir || 'a.py' as path, unnest(['assignment', 'assignment', 'assignment', 'call', 'import', 'import']) as kind, unnest([5, 7, 10, 5, 1, 2]) as line, unnest(['ChatOpenAI', 'os.getenv', 'Agent', 'os.getenv', 'os', 'langchain_openai.ChatOpenAI']) as name, unnest(['llm', 'path', 'agent', '', '', '']) as target from f where k = 1""")
def python_observations(spark, d):
    return extract.observations(_tree(spark, d)).select("root", "path", "kind", "line", "name", "target")


@query(f"""with {_P} select root, dir || 'a.py' as path, unnest([5, 10]) as line, unnest(['llm', 'a' || s]) as name, unnest(['model', 'agent']) as component_type from f where k = 1""")
def scan_symbols(spark, d):
    return extract.SCANNERS["symbols"](_tree(spark, d)).select("root", "path", "line", "name", "component_type")


@query(f"""with {_P} select root, dir || 'data.csv' as path, 'data.csv' as name, 'dataset' as component_type, 0.9 as confidence from f where k = 9""")
def data_files(spark, d):
    return S.binary_assets(_tree(spark, d).withColumn("raw", F.col("content").cast("binary"))).select("root", "path", "name", "component_type", "confidence")


@query(f"""with {_P} select count(*) as files, (select count(*) from f where k = 1) as with_agents from f""")
def scan_coverage(spark, d):
    """Every file is read, and every one that makes an agent is found."""
    tree = _tree(spark, d)
    found = extract.scan(tree, ["symbols"]).where("component_type = 'agent'").select("root", "path").distinct().withColumn("hit", F.lit(True))
    return tree.join(found, ["root", "path"], "left").agg(F.count("*").alias("files"), F.count_if("hit").alias("with_agents"))


_Q = "f as (select 'r' || (p_partkey % 3) as root, 'p' || p_partkey || '/' as dir, p_partkey % 8 as k, p_size as s, p_partkey from part)"


@query(f"""with {_Q} select root, dir || 'langgraph.json' as path, unnest(['g' || s, 'h', 'e-' || s]) as name, unnest(['agent', 'agent', 'embedding']) as component_type, unnest(['./a.py:graph', 'b', '8']) as detail from f where k = 0""")
def graph_configurations(spark, d):
    return S.graph_configs(_tree(spark, d, _MORE))


@query(f"""with {_Q} select root, dir || 'main.tf' as path, unnest(['terraform_variable', 'terraform_local']) as kind, unnest(['region', 'model']) as name, unnest(['r' || s, 'm' || s]) as value from f where k = 1 union all select root, dir || 'values.yaml', 'helm_value', unnest(['llm.name', 'url']), unnest(['gpt-' || s, null]) from f where k = 2 union all select root, dir || 'stack.yaml', unnest(['cloudformation_parameter', 'cloudformation_parameter', 'cloudformation_resource']), unnest(['P', 'Q', 'E']), unnest(['d' || s, null, 'AWS::SageMaker::Endpoint']) from f where k = 3""")
def infrastructure_definitions(spark, d):
    return S.infrastructure_names(_tree(spark, d, _MORE)).drop("ord")


@query(f"""with {_Q} select root, rtrim(dir, '/') as dir from f where k = 4 union all select root, dir || 'sub' from f where k = 5""")
def repositories_found(spark, d):
    return S.repositories_below(_tree(spark, d, _MORE)).select("root", "dir")


@query("""select p_partkey, p_partkey % 5 <> 0 and p_partkey % 5 <> 2 as kept from part""")
def ignored_paths(spark, d):
    k = F.col("p_partkey")
    path = F.when(k % 5 == 0, "a/x.log").when(k % 5 == 1, "a/keep.log").when(k % 5 == 2, "top7/x").when(k % 5 == 3, "a/top7/x").otherwise("b.py")
    rules = S.ignore_lines("# c\n*.log\n!keep.log\n/top7\n")
    own = _t(spark, d, "part").select("p_partkey", path.alias("path"))
    kept = S.without_ignored(own, rules).select("p_partkey", F.lit(True).alias("kept"))
    return own.join(kept, "p_partkey", "left").select("p_partkey", F.coalesce("kept", F.lit(False)).alias("kept"))


@query("""select 'rep' || (p_partkey % 4) as report, 's' || (p_partkey % 3) as source, p_type as component_type, p_name as name, 'f.py' as file_path, p_size as line_number, case when p_partkey % 2 = 0 then 'm' end as model_name from part""")
def reports_read(spark, d):
    """Written by type and read again, with one list for every third source."""
    from inventra.sinks.reports import grouped

    k = F.col("p_partkey")
    c = _t(spark, d, "part").select(F.concat(F.lit("rep"), (k % 4).cast("string")).alias("report"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("source"), F.col("p_type").alias("component_type"), F.col("p_name").alias("name"), F.lit("f.py").alias("file_path"), F.col("p_size").alias("line_number"), F.when(k % 2 == 0, "m").alias("model_name"), k.alias("ord"))
    by_type = grouped(c.withColumn("source", F.concat_ws("/", "report", "source")))
    sources = by_type.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("component_type", "components"))).alias("components"))
    split = sources.select(F.split_part("source", F.lit("/"), F.lit(1)).alias("report"), F.split_part("source", F.lit("/"), F.lit(2)).alias("source"), "components")
    reports = split.groupBy("report").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("source", F.struct("components")))).alias("sources"))).alias("content"))
    return S.read_reports(reports).drop("ord")


_AGENT = "select p_partkey as id, case p_partkey % 6 when 0 then 'Agent' when 1 then 'tool' when 2 then 'model' when 3 then 'embedding_model' when 4 then 'datastore' else 'memory' end as cat, 'f' || (p_size % 7) as f, 'v' || (p_size % 9) as v, case when p_partkey % 4 = 0 then 'only' || p_partkey else 'many' end as name, p_size as s from part"


def _wired(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    kind = F.element_at(F.array(*map(F.lit, ("Agent", "tool", "model", "embedding_model", "datastore", "memory"))), (k % 6 + 1).cast("int"))
    v = lambda n: F.concat(F.lit("VARIABLE:v"), (n % 9).cast("string"))
    arguments = F.create_map(F.lit("tools"), F.concat(F.lit("LIST:"), v(size + 1), F.lit(",ATTRIBUTE:self.v"), ((size + 2) % 9).cast("string")), F.lit("my_LLM"), v(size + 3), F.lit("embed_fn"), F.concat(F.lit("VARIABLE:only"), (k + 3).cast("string")), F.lit("other"), v(size + 4), F.lit("sub_agents"), v(size + 5))
    return _t(spark, d, "part").select(k.cast("string").alias("instance_id"), F.when(k % 4 == 0, F.concat(F.lit("only"), k.cast("string"))).otherwise("many").alias("name"), kind.alias("category"), F.concat(F.lit("f"), (size % 7).cast("string")).alias("file_path"), F.concat(F.lit("v"), (size % 9).cast("string")).alias("assigned_target"), arguments.alias("arguments"), k.alias("ord"), (k % 12 == 0).alias("wired"))


@query(f"""with c as ({_AGENT}), bv as (select f, v, arg_max(id, id) as id from c group by 1, 2), bn as (select name, min(id) as id from c group by 1 having count(*) = 1),
r as (select id, f, 'USES_TOOL' as label, unnest(['v' || ((s + 1) % 9), 'v' || ((s + 2) % 9)]) as name from c where cat = 'Agent' union all select id, f, 'USES_LLM', 'v' || ((s + 3) % 9) from c where cat = 'Agent' union all select id, f, 'USES_AGENT', 'v' || ((s + 5) % 9) from c where cat = 'Agent' union all select id, f, 'USES_EMBEDDING', 'only' || (id + 3) from c where cat in ('Agent', 'datastore')),
t as (select r.id, label, coalesce(bv.id, bn.id) as target from r left join bv on bv.f = r.f and bv.v = r.name left join bn on bn.name = r.name)
select distinct cast(t.id as varchar) as source_instance_id, cast(target as varchar) as target_instance_id, label from t join c on c.id = target where (label = 'USES_TOOL' and cat = 'tool') or (label = 'USES_LLM' and cat = 'model') or (label = 'USES_EMBEDDING' and cat = 'embedding_model') or (label = 'USES_AGENT' and cat = 'Agent' and t.id <> target)""")
def derived_edges(spark, d):
    from inventra.operators.derive import derived_edges as derive

    return derive(_wired(spark, d)).select("source_instance_id", "target_instance_id", "label")


@query(f"""with c as ({_AGENT}), n as (select f, case cat when 'model' then 'llm' when 'embedding_model' then 'llm' when 'tool' then 'tools' when 'memory' then 'memory' end as kind, 'VARIABLE:' || v as ref, id from c), h as (select f, kind, case when kind = 'tools' then 'LIST:' || string_agg(ref, ',' order by id) else arg_min(ref, id) end as v from n where kind is not null group by 1, 2)
select cast(id as varchar) as instance_id, kind, h.v as value from c join h using (f) where cat = 'Agent' and id % 12 = 0""")
def same_file_wiring(spark, d):
    from inventra.operators.derive import same_file_arguments

    c = _wired(spark, d).withColumn("arguments", F.create_map(F.lit("x"), F.lit("y")))
    out = same_file_arguments(c).where(F.col("wired") & (F.col("category") == "Agent"))
    return out.select("instance_id", F.explode("arguments").alias("kind", "value")).where("kind <> 'x'")


_D = "f as (select 'r' || (p_partkey % 3) as root, 'p' || p_partkey || '/' as dir, p_partkey % 6 as k, p_size as s, p_partkey from part)"


@query(f"""with {_D} select root, dir || 'requirements.txt' as path, 'openai' as name, cast(s as varchar) as spec, 2 as line, cast(s as varchar) as pin, 'pypi' as ecosystem from f where k = 0 union all select root, dir || 'deps/base.in', 'torch', '1', 2, '1', 'pypi' from f where k = 0 union all select root, dir || 'deps/more/x.in', 'flask', '*', 1, null, 'pypi' from f where k = 0
union all select root, dir || 'pnpm-lock.yaml', unnest(['openai', '@a/b']), unnest(['4.' || s || '.0', '1.0']), unnest([2, 4]), unnest(['4.' || s || '.0', '1.0']), 'npm' from f where k = 1""")
def included_manifests(spark, d):
    tree = _tree(spark, d, _DEEP)
    base = tree.where(F.col("path").endswith("requirements.txt"))
    more = lambda name, text: base.withColumn("path", F.regexp_replace("path", r"requirements\.txt$", name)).withColumn("content", F.lit(text))
    # Each include leads on, and the last one back to the first.
    tree = tree.unionByName(more("deps/base.in", "-r more/x.in\ntorch==1\n")).unionByName(more("deps/more/x.in", "flask\n-r ../base.in\n"))
    return S.manifests(tree).drop("ord")


@query(f"""with {_D} select root, dir || 'loop.py' as path, unnest(['import', 'import', 'annotation', 'method', 'loop', 'note', 'class']) as kind, unnest([1, 2, 3, 5, 6, 10, 4]) as line, unnest(['a.b', '.x.y', 'T.U', 'R.run', 'R.run', '# asset: concept=agent', 'R']) as name, unnest(['c', '', 'z', 'R', 'while', '', '']) as target, unnest([null, null, null, 'llm.invoke,self.p,self.f', 'llm.invoke,self.p,self.f', null, null]) as callees from f where k = 2""")
def python_structure(spark, d):
    o = extract.observations(_tree(spark, d, _DEEP)).where(F.col("kind").isin("import", "annotation", "method", "loop", "note", "class"))
    return o.select("root", "path", "kind", "line", "name", "target", F.col("arguments")["callees"].alias("callees"))


@query(f"""with {_D} select root, dir || 'loop.py' as path, 4 as line, 'R' as name, 'agent' as component_type from f where k = 2""")
def structural_agents(spark, d):
    return extract.SCANNERS["structural"](_tree(spark, d, _DEEP)).select("root", "path", "line", "name", "component_type")


@query(f"""with {_D} select root, dir || case k when 3 then 'w.gguf' when 4 then 'm.onnx' else 'k.keras' end as path, case k when 3 then 'gguf' when 4 then 'onnx' else 'keras' end as format, k = 3 as verified, case when k = 3 and p_partkey % 2 = 1 then 3 end as version from f where k >= 3""")
def model_file_headers(spark, d):
    raw = F.when((F.col("path").endswith(".gguf")) & F.col("path").rlike(r"^p\d*[13579]/"), F.unhex(F.lit("4747554603000000"))).otherwise(F.col("content").cast("binary"))
    return S.model_headers(_tree(spark, d, _DEEP).withColumn("raw", raw)).select("root", "path", "format", "verified", "version")


@query(f"""with {_D} select kind, count(*) as n from (select unnest(['import', 'import', 'call', 'call', 'assignment']) as kind from f where k = 2 and p_partkey = 2) group by 1""")
def one_file_analysis(spark, d):
    return extract.analysis(_tree(spark, d, _DEEP), "p2/loop.py").groupBy("kind").agg(F.count("*").alias("n"))


_MADE = (("made.py", "from langchain_openai import ChatOpenAI as C\nimport crewai\nfrom mcp.server.fastmcp import FastMCP\nfrom other import Agent\nllm = C(model='m%d')\nlead = crewai.Agent(name='lead%d', llm=llm)\nmcp = FastMCP('srv')\n@mcp.tool()\ndef look(): pass\nx = llm.bind(a=1)\nn = crewai.chains.LLMChain()\nz = Agent(name='z')\nwith C() as y: pass\nfar = faraway.Agent()\n"),)
_CATALOGUE = [("langchain_openai.ChatOpenAI", "model", "class", "langchain_openai"), ("langchain_openai.ChatOpenAI.bind", "model", "Method", "langchain_openai"), ("crewai.Agent", "Agent", "class", "crewai"), ("crewai.chains.LLMChain", "agent", "class", "crewai"), ("mcp.server.fastmcp.FastMCP", "mcp_server", "class", "mcp"), ("mcp.server.fastmcp.FastMCP.tool", "tool", "decorator", "mcp"), ("crewai.Nothing", "unknown", "class", "crewai")]


@query(f"""with {_D} select root, dir || 'made.py' as path, unnest([5, 6, 7, 8, 13, 14]) as line, unnest(['langchain_openai.ChatOpenAI', 'lead' || s, 'srv', 'look', 'langchain_openai.ChatOpenAI', 'Agent']) as name, unnest(['model', 'agent', 'mcp_server', 'tool', 'model', 'model']) as component_type, unnest(['langchain_openai', 'crewai', 'mcp', 'mcp', 'langchain_openai', 'faraway']) as framework, unnest([0.8, 0.8, 0.8, 0.8, 0.8, 0.3]) as confidence from f where k = 0""")
def catalogue_assets(spark, d):
    k = spark.createDataFrame(_CATALOGUE, "id string, concept string, label string, framework string")
    return extract.catalogue_assets(_tree(spark, d, _MADE + (("x.py", ""),) * 5), k).select("root", "path", "line", "name", "component_type", "framework", "confidence")


_APP = "from lib import go\nfrom q import *\ndef one(): pass\n@tool\n# c\ndef two(): pass\nmk = make()\nlst = []\ndef f(p):\n    agent(tools=[one, lst, p, mk, go])\n    add_tool(go)\n    def one(): pass\n"
_TOOLS = [(1, "app.py", 4, "two", None), (2, "app.py", 10, "one", anchors.KWARG), (3, "app.py", 10, "lst", anchors.KWARG), (4, "app.py", 10, "p", anchors.KWARG), (5, "app.py", 10, "mk", anchors.KWARG), (6, "app.py", 10, "go", anchors.KWARG), (7, "app.py", 11, "go", "add_tool(go)"), (8, "app.py", 3, "one", None), (9, "app.py", 11, "two", None), (10, "x.ts", 4, "two", None)]


@query("""with f as (select p_partkey as k, 'p' || p_partkey || '/' as dir from part) select k * 100 + i as id, dir || case i when 7 then 'lib/inner.py' when 10 then 'x.ts' else 'app.py' end as path, case i when 1 then 6 when 2 then 2 when 5 then 10 when 6 then 1 when 7 then 1 when 8 then 3 when 9 then 6 else 4 end as line, case when i in (2, 6) then 'import' end as anchor, case when i = 7 then dir || 'app.py' end as reported_path, case i when 1 then 4 when 2 then 10 when 6 then 10 when 7 then 11 when 9 then 11 end as reported_line from (select *, unnest([1, 2, 5, 6, 7, 8, 9, 10]) as i from f)""")
def tool_anchors(spark, d):
    k = F.col("p_partkey")
    part = _t(spark, d, "part").select(k.alias("k"), F.concat(F.lit("p"), k.cast("string"), F.lit("/")).alias("dir"))
    kinds = [("app.py", _APP), ("lib/__init__.py", "from .inner import go\n"), ("lib/inner.py", "def go(): pass\n")]
    files = part.select(F.lit("r").alias("root"), "dir", F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(c).alias("content")) for p, c in kinds))).alias("f")).select("root", F.concat("dir", "f.p").alias("path"), "f.content")
    tools = part.select("k", "dir", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), F.lit(n).alias("line"), F.lit(name).alias("name"), F.lit(via).cast("string").alias("via")) for i, p, n, name, via in _TOOLS))).alias("t"))
    return anchors.aligned(tools.select((F.col("k") * 100 + F.col("t.i")).alias("id"), F.lit("r").alias("root"), F.concat("dir", "t.p").alias("path"), "t.line", "t.name", "t.via"), files)


@query("""select p_partkey as agent, case p_partkey % 5 when 0 then 'llm' when 2 then 'memory' else 'tools' end as slot, case p_partkey % 5 when 0 then 'v' when 1 then 'b' when 2 then 'T' else 'Node' || p_partkey end as reference from part where p_partkey % 5 < 4""")
def graph_wiring(spark, d):
    k, p = F.col("p_partkey"), _t(spark, d, "part").select("p_partkey")
    n = k.cast("string")
    by = lambda *values: F.element_at(F.array(*(v if not isinstance(v, str) else F.lit(v) for v in values)), (k % 5 + 1).cast("int"))
    file = F.concat(F.lit("f"), n, F.lit(".py"))
    nodes = p.select(k.alias("agent"), file.alias("file_path"), by("v", "fn", "T", F.concat(F.lit("Node"), n), "none").alias("ref"), by("ref", "ref", "inner", "call", "ref").alias("kind"))
    c = p.select(k.alias("instance_id"), by("chat_model", "tool", "memory", "tool", "agent").alias("category"), by("X", F.concat(F.lit("pkg.Tool"), n), "M", F.concat(F.lit("lg.Node"), n), "A").alias("name"), by("v", "", "T", "", "").alias("assigned_target"),
                 by(file, "x.py", F.concat(F.lit("src/m"), n, F.lit("/tools.py")), "x.py", "x.py").alias("file_path"), k.alias("ord"))
    imports = p.where("p_partkey % 5 = 2").select(file.alias("file_path"), F.lit("T").alias("key"), F.concat(F.lit("m"), n, F.lit(".tools.T")).alias("value"))
    calls = p.where("p_partkey % 5 = 1").select(file.alias("file_path"), F.lit("fn").alias("func"), F.concat(F.lit("a.pkg.Tool"), n).alias("name"), F.lit("a.b").alias("target"), k.alias("ord"))
    return derive.wired_arguments(nodes, c, imports, calls)
