"""Queries of flow through code, of spans and of what languages other than Python
say: file contents vary with the rows of a table, and twins compute from the same
columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from inventra.catalogue import _t, query
from inventra.operators import evidence, flow, graph, infrastructure, languages, lifecycle, pipelines, spans
from inventra.streaming import watch
from inventra.tables import shared_dir, stored

#: A module by the remainder of its part's size: a list that takes in another
#: module's, one whose function goes through a wrapper, a field of an object, and
#: a list grown from a parameter.  %k is its number, %j that of the other module.
_LISTS = (
    "from .m%j import T%j\ndef f%k(q): return q\nT%k = [f%k, *T%j]\n",
    "from .m%j import T%j\ndef f%k(q): return q\ndef wrap(g):\n    def inner(*a): return g(*a)\n    return inner\nT%k = [wrap(f%k)] + list(T%j)\n",
    "from .m%j import T%j\ndef f%k(q): return q\nclass Box: pass\nB = Box(own=[f%k], more=T%j)\nT%k = B.more\n",
    "from .m%j import T%j\ndef f%k(q): return q\ndef make%k(given):\n    out = []\n    for g in given:\n        out.append(g)\n    return out\nT%k = make%k(T%j)\n",
)
_LOOP = "for tool in T%k:\n    server.add_tool(Tool.from_function(tool))\n"


def _filled(text: Column | str, **by: Column) -> Column:
    out = F.lit(text)
    for name, value in by.items():
        out = F.replace(out, F.lit(f"%{name}"), value.cast("string"))
    return out


@query("""with recursive m as (select p_partkey as k, p_size % 4 as kind, case when p_partkey < 8 then 7 - p_partkey else p_partkey // 8 end as j from part),
c as (select *, [4, 4, 3, 6][kind + 1] as hop, [2, 4][kind + 1] as own, [5, 8, 7, 10][kind + 1] as line from m),
walk(id, node, d) as (select k, k, 0 from c union select id, j, d + hop from walk join c on k = node where d + hop <= 24),
found as (select distinct id, 'p/m' || node || '.py' as path, 'f' || node as name, 2 as line from walk join c on k = node where d + own <= 24)
select k as id, path, name, found.line from c left join found on id = k""")
def loop_registrations(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    other = F.when(k < 8, 7 - k).otherwise(F.call_function("div", k, F.lit(8)))
    kinds = [_filled(text + _LOOP, k=k, j=other) for text in _LISTS]
    lines = [text.count("\n") + 2 for text in _LISTS]
    pick = lambda values: F.element_at(F.array(*values), (size % 4 + 1).cast("int"))
    part = _t(spark, d, "part").select(k.alias("id"), F.lit("r").alias("root"), F.concat(F.lit("p/m"), k.cast("string"), F.lit(".py")).alias("path"), pick(kinds).alias("content"), pick([F.lit(n) for n in lines]).alias("line"))
    return flow.registered(part.select("id", "root", "path", "line", F.lit("tool").alias("name")), part)


#: Classes by the remainder of their part's size: one in another with an agent made
#: by an imported name, a model that serves a card, a loop over a model's calls that
#: also calls an agent elsewhere, a workflow, and a loop that is nothing.
_CLASSES = (
    "from crewai import Agent as A\nclass Outer%k:\n    class Inner:\n        def go(self):\n            self.a = A(role='r')\n    def g(self): pass\n",
    "import pydantic\nclass M%k(pydantic.BaseModel):\n    u: str = '/.well-known/agent.json'\n",
    "import boto3\nclass C%k:\n    def f(self):\n        while True:\n            r = self.llm.invoke(m)\n            if r.calls: self.tool(r)\n            self.keep(r)\n        return self.c.invoke_agent(1)\n",
    "from temporalio import workflow\n@workflow.defn\nclass W%k:\n    def run(self):\n        s = ClientSession(1)\n",
    "class N%k:\n    def f(self):\n        for x in y:\n            a(x)\n            b(x)\n            if x: c(x)\n",
)
_HELD = "c as (select * from (values (0, 'Outer', 2, 6), (0, 'Inner', 3, 5), (1, 'M', 2, 3), (2, 'C', 2, 8), (3, 'W', 3, 5), (4, 'N', 1, 6)) t(v, name, b, e)), f as (select p_partkey as k, p_size % 5 as v, p_partkey % 4 as pad from part), h as (select 'r' || (k % 3) as root, 'm' || k || '.py' as path, case name when 'Inner' then name else name || k end as class_name, b + pad as class_start, e + pad as class_end, name, v, pad from f join c using (v))"


def _class_facts(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    text = F.element_at(F.array(*(_filled(t, k=k) for t in _CLASSES)), (size % 5 + 1).cast("int"))
    part = _t(spark, d, "part").select(F.concat(F.lit("r"), (k % 3).cast("string")).alias("root"), F.concat(F.lit("m"), k.cast("string"), F.lit(".py")).alias("path"), F.concat(F.repeat(F.lit("\n"), (k % 4).cast("int")), text).alias("content"))
    return stored(evidence.facts(part))


@query(f"""with {_HELD}, m as (select * from (values ('Outer', 'framework', 'crewai.Agent', 'framework_agent', 5, 5), ('Inner', 'framework', 'crewai.Agent', 'framework_agent', 5, 5), ('M', 'anti', 'pydantic.basemodel', 'pydantic_basemodel', 2, 2), ('M', 'protocol', 'a2a.server', 'a2a_server', 3, 3), ('C', 'react_loop', 'structural.react_loop', 'react_loop', 4, 7), ('C', 'remote', 'aws.bedrock_agents', 'remote', 8, 8), ('W', 'anti', 'temporal.workflow', 'temporal_workflow', 3, 3), ('W', 'protocol', 'mcp.client', 'other', 5, 5)) t(name, kind, signature, pattern, s, e))
select root, path, class_name, class_start, class_end, kind, signature, pattern, s + pad as start_line, e + pad as end_line from h join m using (name)""")
def evidence_matches(spark, d):
    return evidence.matches(_class_facts(spark, d)).drop("qualified_name", "rationale")


@query(f"""with {_HELD} select root, path, class_name, case name when 'Inner' then 'Outer' || regexp_extract(path, '\\d+') || '.Inner' else class_name end as qualified_name, class_start, class_end, case v when 0 then 'framework_agent' when 1 then 'a2a_server' when 2 then 'react_loop' when 3 then 'other' end as preferred, v < 3 as direct, false as proxy, v in (1, 3) as excluded from h""")
def agent_dossiers(spark, d):
    return evidence.dossiers(_class_facts(spark, d)).drop("signatures")


@query("""with p as (select l_orderkey as k, l_linenumber as line, l_quantity::bigint as place from lineitem), s as (select o_orderkey as k, o_custkey % 20 as lo, o_custkey % 20 + o_custkey % 27 as hi, o_custkey as name from orders union all select o_orderkey, 5, 30, -o_custkey from orders)
select p.k, line, place, name from p join s on p.k = s.k and place between lo and hi""")
def points_in_spans(spark, d):
    p = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("long").alias("place"))
    c = F.col("o_custkey")
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), c, F.explode(F.array(F.struct((c % 20).alias("lo"), (c % 20 + c % 27).alias("hi"), c.alias("name")), F.struct(F.lit(5).cast("long").alias("lo"), F.lit(30).cast("long").alias("hi"), (-c).alias("name")))).alias("s")).select("k", "s.*")
    return spans.stabbed(p, o, ["k"], "place", "lo", "hi").select("k", "line", "place", "name")


@query("""with p as (select l_orderkey as k, l_linenumber as line, l_quantity::bigint as place from lineitem), s as (select o_orderkey as k, o_custkey % 20 as lo, o_custkey % 20 + o_custkey % 27 as hi from orders)
select k, line, place from p where not exists (select 1 from s where s.k = p.k and place between lo and hi)""")
def points_outside(spark, d):
    p = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("long").alias("place"))
    c = F.col("o_custkey")
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (c % 20).alias("lo"), (c % 20 + c % 27).alias("hi"))
    return spans.outside(p, o, ["k"], "place", "lo", "hi")


#: A file of each language by the remainder of its part's key: what stands in
#: comments, raw and block texts doesn't count, what stands in a template's braces does.
_SOURCES = (
    ("a.ts", "/* import x from 'openai'\n new Agent( */\nimport OpenAI from 'openai';\nconst a = new Agent({ model: 'm%k' }); // new Agent(\nconst s = `new Agent( ${createTool(1)}`;\n"),
    ("a.go", "package p\nimport (\n\t// \"github.com/tmc/langchaingo\"\n\to \"github.com/sashabaranov/go-openai\"\n)\nvar e = os.Getenv(\"OPENAI_API_KEY\")\nvar r = `model: \"no\"`\nvar q = c{model: \"g%k\"}\n"),
    ("A.java", "import dev.langchain4j.model.X;\n/* new Agent( */\nString t = \"\"\"\n new Agent( \"model: x\"\n\"\"\";\nObject a = new Agent(b.model(\"j%k\"));\n"),
    ("a.rs", "// use llm::x;\n/* a /* use burn::x */ use burn::y */\nlet m = Q { model: \"r%k\" };\n"),
    ("a.rb", "require 'langchainrb'\n=begin\nrequire 'ruby-openai'\n=end\nx = c.model(\"b%k\")\n"),
    ("a.cs", "var t = @\"using Microsoft.ML;\"; // new Agent(\nvar n = new MyTool(1);\n"),
)


@query("""with f as (select p_partkey as k, p_partkey % 6 as v, p_size % 3 as pad from part), m as (select * from (values (0, 'a.ts', 3, 'openai', 'dependency', 'npm', 0.85), (0, 'a.ts', 4, 'Agent', 'agent', 'npm', 0.7), (0, 'a.ts', 4, 'm', 'model', 'npm', 0.75), (0, 'a.ts', 5, 'tool_pattern_2', 'tool', 'npm', 0.65),
(1, 'a.go', 4, 'github.com/sashabaranov/go-openai', 'dependency', 'go', 0.85), (1, 'a.go', 8, 'g', 'model', 'go', 0.75), (1, 'a.go', 6, 'env:OPENAI_API_KEY', 'secret', 'go', 0.3), (2, 'A.java', 1, 'dev.langchain4j', 'dependency', 'maven', 0.85), (2, 'A.java', 6, 'Agent', 'agent', 'maven', 0.7), (2, 'A.java', 6, 'j', 'model', 'maven', 0.75),
(3, 'a.rs', 3, 'r', 'model', 'cargo', 0.75), (4, 'a.rb', 1, 'langchainrb', 'dependency', 'rubygems', 0.85), (4, 'a.rb', 5, 'b', 'model', 'rubygems', 0.75), (5, 'a.cs', 2, 'tool_pattern_0', 'tool', 'nuget', 0.25)) t(v, file, line, name, component_type, framework, confidence))
select 'r' || (k % 5) as root, 'p' || k || '/' || file as path, line + pad as line, case component_type when 'model' then name || k else name end as name, component_type, framework, cast(confidence as double) as confidence from f join m using (v)""")
def language_components(spark, d):
    k = F.col("p_partkey")
    pick = lambda values: F.element_at(F.array(*values), (k % 6 + 1).cast("int"))
    text = F.concat(F.repeat(F.lit("\n"), (F.col("p_size") % 3).cast("int")), pick([_filled(t, k=k) for _, t in _SOURCES]))
    files = _t(spark, d, "part").select(F.concat(F.lit("r"), (k % 5).cast("string")).alias("root"), F.concat(F.lit("p"), k.cast("string"), F.lit("/"), pick([F.lit(p) for p, _ in _SOURCES])).alias("path"), text.alias("content"))
    return languages.components(files)


@query("""with last as (select user_id, max(ts) as mtime, arg_max(event_type || ':' || event_id, ts) as content from events group by 1)
select 'r' as root, 'u' || user_id as path, epoch_ms(mtime) // 1000 as second, content from last where epoch_ms(mtime) + 21600000 < epoch_ms((select max(ts) from events)) - 3600000""")
def settled_changes(spark, d):
    """A stream of changes: files that nobody has written for six hours.  Of events at
    one time the first counts, as with the twin where it runs on one thread."""
    place = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    schema = _t(spark, d, "events").schema
    # A pattern, as a stream takes no path of a single file.
    rows = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    changes = rows.select(F.lit("r").alias("root"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.col("ts").cast("timestamp").alias("mtime"), F.concat_ws(":", "event_type", F.col("event_id").cast("string")).alias("content"), F.col("event_id").alias("ord"))
    told = watch.settled(changes, quiet=6 * 3600, late=3600)
    told.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(watch.CHANGES).parquet(f"{place}/rows").select("root", "path", F.unix_seconds("mtime").alias("second"), "content")


#: Infrastructure by the remainder of its part's key: a job, values of a chart whose
#: template gives one of them to a variable, Terraform, CloudFormation and ARM.
_PLATFORMS = (
    ("job.yaml", "apiVersion: batch/v1\nkind: Job\nspec:\n  template:\n    spec:\n      containers:\n        - name: t%k\n          image: huggingface-pytorch-training:%k\n          resources: {limits: {nvidia.com/gpu: 2}}\n          env:\n            - {name: MODEL_NAME, value: own-%k}\n            - {name: OTHER, value: gpt-4o}\n"),
    ("chart/values.yaml", "llm:\n  model: gpt-4o\n  engine: deploy-%k\nstore:\n  db_type: qdrant\n  endpoint: http://w%k:80\nimage:\n  repository: ollama/ollama\n  tag: gpt-4o\n"),
    ("main.tf", "resource \"aws_sagemaker_model\" \"m%k\" {\n  image = \"vllm/vllm:%k\"\n  x { instance_type = \"small\" }\n  instance_type = \"ml.p4d.24xlarge\"\n}\nresource \"aws_s3_bucket\" \"b\" { model_id = \"no\" }\n"),
    ("stack.yaml", "AWSTemplateFormatVersion: x\nResources:\n  E%k:\n    Type: AWS::SageMaker::Model\n    Properties: {ModelId: !Ref P, Container: {ModelName: m-%k, ModelS3Uri: s3://b/%k}}\n  N:\n    Type: AWS::S3::Bucket\n    Properties: {ModelId: no}\n"),
    ("arm.json", "{\"$schema\": \"https://x/deploymentTemplate.json#\", \"resources\": [{\"type\": \"Microsoft.CognitiveServices/accounts\", \"name\": \"acc%k\", \"properties\": {\"sku\": {\"name\": \"Standard_NC%k\"}}}, {\"type\": \"Other\", \"name\": \"x\"}]}"),
)
_TEMPLATE = "env:\n  - name: LLM_%k\n    value: {{ .Values.llm.model }}\n"


@query("""with f as (select p_partkey as k, p_partkey % 5 as v, p_size % 3 as pad from part), m as (select * from (values (0, 'job.yaml', 8, 'huggingface-pytorch-training:%', 'dependency', null, 1.0, null, null), (0, 'job.yaml', 8, 'training:t%', 'training_run', null, 1.0, null, null), (0, 'job.yaml', 11, 'env:MODEL_NAME', 'model', 'own-%', 1.0, 'MODEL_NAME', null),
(1, 'chart/values.yaml', 2, 'gpt-4o', 'model', 'gpt-4o', 0.95, 'LLM_%', null), (1, 'chart/values.yaml', 3, 'deploy-%', 'model', 'deploy-%', 0.5, null, null), (1, 'chart/values.yaml', 6, 'http://w%:80', 'vector_store', null, 0.95, 'endpoint', 'qdrant'), (1, 'chart/values.yaml', 8, 'ollama/ollama', 'dependency', null, 1.0, null, null),
(2, 'main.tf', 1, 'aws_sagemaker_model.m%', 'other', null, 1.0, null, null), (2, 'main.tf', 2, 'vllm/vllm:%', 'dependency', null, 1.0, null, null), (2, 'main.tf', 4, 'gpu_instance:ml.p4d.24xlarge', 'training_run', null, 1.0, null, null),
(3, 'stack.yaml', -1, 'E%', 'other', null, 1.0, null, null), (3, 'stack.yaml', -1, 'm-%', 'model', 'm-%', 1.0, null, null), (3, 'stack.yaml', -1, 's3://b/%', 'model_artifact', null, 1.0, null, null), (4, 'arm.json', -1, 'acc%', 'other', null, 1.0, null, null), (4, 'arm.json', -1, 'sku:Standard_NC%', 'training_run', null, 1.0, null, null)) t(v, file, line, name, component_type, model_name, confidence, env_var, technology))
select 'p' || k || '/' || file as path, case when line < 0 then 1 else line + pad end as line, replace(name, '%', k::varchar) as name, component_type, replace(model_name, '%', k::varchar) as model_name, cast(confidence as double) as confidence, replace(env_var, '%', k::varchar) as env_var, technology from f join m using (v)""")
def infrastructure_assets(spark, d):
    k = F.col("p_partkey")
    pick = lambda values: F.element_at(F.array(*values), (k % 5 + 1).cast("int"))
    pad = F.repeat(F.lit("\n"), (F.col("p_size") % 3).cast("int"))
    own = F.struct(pick([F.lit(p) for p, _ in _PLATFORMS]).alias("file"), F.concat(pad, pick([_filled(t, k=k) for _, t in _PLATFORMS])).alias("content"))
    template = F.when(k % 5 == 1, F.struct(F.lit("chart/templates/deploy.yaml").alias("file"), _filled(_TEMPLATE, k=k).alias("content")))
    files = _t(spark, d, "part").select("p_partkey", F.explode(F.array_compact(F.array(own, template))).alias("f"))
    files = files.select(F.lit("r").alias("root"), F.concat(F.lit("p"), k.cast("string"), F.lit("/"), F.col("f.file")).alias("path"), "f.content")
    return infrastructure.components(files).drop("root", "needs_agentic", "shape", "place")


@query("""with recursive t as (select conv_id as c, turn as n, 10 * turn + 1 as line from conversations group by 1, 2), b as (select c, max(n) as top from t group by 1 having max(n) >= 6),
w as (select c, n, case when n = top then 0 else (top - n + 1) // 2 end as distance, top from t join b using (c) where top - n <= 6),
r as (select *, row_number() over (partition by c order by distance, n) as position from w), k as (select r.c, r.n, r.distance, r.position, (select min_by(x.n, x.position) from r x where x.c = r.c and x.n - r.n in (1, 2) and x.distance = r.distance - 1) as child from r)
select c as id, position, distance, c || '.' || n as function_id, 10 * n + 1 as line, case when position > 1 then c || '.' || child end as child, case when position > 1 then 10 * n + child - n end as call_line from k where position <= 6""")
def workflow_context(spark, d):
    """Turns as functions that call the next two; the last turn of each long talk is asked for."""
    t = _t(spark, d, "conversations").select(F.col("conv_id").alias("c"), F.col("turn").alias("n")).distinct()
    name = lambda n: F.concat_ws(".", F.col("c").cast("string"), n.cast("string"))
    functions = t.select(name(F.col("n")).alias("function_id"), name(F.col("n")).alias("qualname"), F.col("c").cast("string").alias("file_path"), (10 * F.col("n") + 1).alias("start_line"), (10 * F.col("n") + 9).alias("end_line"), F.array().cast("array<string>").alias("parameters"))
    step = F.explode(F.array(F.lit(1), F.lit(2)))
    calls = t.withColumn("s", step).select(name(F.col("n")).alias("caller"), name(F.col("n") + F.col("s")).alias("callee"), (10 * F.col("n") + F.col("s")).alias("line"), F.lit("x").alias("arguments"), F.col("s").alias("ord"))
    points = t.groupBy("c").agg(F.max("n").alias("n")).where("n >= 6").select(F.col("c").alias("id"), F.col("c").cast("string").alias("file_path"), (10 * F.col("n") + 5).alias("line"))
    return graph.workflows(points, functions, calls, hops=3, most=6).select("id", F.col("position").cast("long").alias("position"), "distance", "function_id", "line", "child", "call_line")


_CI = (
    (".github/workflows/a%k.yml", "on: push\njobs:\n  t%k:\n    container: {image: pytorch/pytorch:%k}\n    steps:\n      - uses: iterative/setup-dvc@v%k\n      - name: fit%k\n        run: |\n          python train.py --model=m-%k\n        env:\n          KEY: ${{ secrets.HF_TOKEN }}\n          M: ${{ secrets.M || 'gpt-4o' }}\n      - run: echo done\n"),
    (".gitlab-ci.yml", "stages: [a]\nvariables: {X: vllm}\nserve%k:\n  image: {name: vllm/vllm:%k}\n  before_script: [ls]\n  script:\n    - echo\n    - vllm serve m%k\n    - train more\n.hidden:\n  image: ollama\n"),
    (".github/workflows/b%k.yaml", "name: no jobs, so no OPENAI_API_KEY\n"),
)


@query("""with f as (select p_partkey as k, p_partkey % 3 as v, p_size % 3 as pad from part), m as (select * from (values (0, 't%', 11, 'HF_TOKEN', 'secret', '', null, 1.0), (0, 't%', 0, 'pytorch/pytorch:%', 'dependency', 'docker', null, 1.0), (0, 't%', 0, 'iterative/setup-dvc', 'dependency', 'github_actions', null, 1.0), (0, 't%', 0, 'fit%', 'training_run', '', null, 1.0), (0, 't%', 0, 'm-%', 'model', '', 'm-%', 0.5), (0, 't%', 0, 'gpt-4o', 'model', '', 'gpt-4o', 0.7),
(1, 'serve%', 0, 'vllm/vllm:%', 'dependency', 'docker', null, 1.0), (1, 'serve%', 0, 'serve%', 'ml_pipeline', '', null, 1.0)) t(v, job, line, name, component_type, framework, model_name, confidence))
select 'p' || k || case v when 0 then '/.github/workflows/a' || k || '.yml' else '/.gitlab-ci.yml' end as path, case when line > 0 then line + pad else 0 end as line, replace(name, '%', k::varchar) as name, component_type, framework, replace(model_name, '%', k::varchar) as model_name, cast(confidence as double) as confidence, case when component_type <> 'secret' then replace(job, '%', k::varchar) end as job from f join m using (v)""")
def ci_assets(spark, d):
    k = F.col("p_partkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % 3 + 1).cast("int"))
    pad = F.repeat(F.lit("\n"), (F.col("p_size") % 3).cast("int"))
    # One text is picked and then filled, not each of them filled.
    files = _t(spark, d, "part").select(F.lit("r").alias("root"), F.concat(F.lit("p"), k.cast("string"), F.lit("/"), _filled(pick([p for p, _ in _CI]), k=k)).alias("path"), F.concat(pad, _filled(pick([t for _, t in _CI]), k=k)).alias("content"))
    return pipelines.components(files).drop("root", "needs_agentic")


_TRAINING = (
    "import torch\nfrom datasets import load_dataset\nt = Trainer(learning_rate=%k, fp16=True)\nt.train()\ntorch.save(m, 's3://b/w%k.pt')\n",
    "x.fit(1)\nd = pd.read_csv('gs://b/t%k.csv')\ndropout = 'p%k'\nbatches = 1\n",
    "from google.cloud import aiplatform\nwandb.init(%k)\ncreate_training_job(x)\n",
)


@query("""with f as (select p_partkey as k, p_partkey % 3 as v, p_size % 3 as pad from part), m as (select * from (values (0, 2, 'dataset', 'dataset', 'huggingface/datasets', 0.85, null), (0, 3, 'training_run', 'training_run', 'huggingface/transformers', 0.9, null), (0, 3, 'hyperparameter:learning_rate', 'hyperparameter', 'python-kwargs', 0.85, '%'), (0, 3, 'hyperparameter:fp16', 'hyperparameter', 'python-kwargs', 0.85, 'True'), (0, 4, 'training_run', 'training_run', 'pytorch', 0.9, null), (0, 5, 'model_artifact', 'model_artifact', 'cloud-storage', 0.9, 's3://b/w%.pt'), (0, 5, 'model_artifact', 'model_artifact', 'pytorch', 0.9, 's3://b/w%.pt'),
(1, 1, 'training_run', 'training_run', 'keras/pytorch', 0.3, null), (1, 2, 'dataset', 'dataset', 'pandas', 0.3, 'gs://b/t%.csv'), (1, 2, 'dataset', 'dataset', 'cloud-storage', 0.3, 'gs://b/t%.csv'), (1, 3, 'hyperparameter:dropout', 'hyperparameter', 'python-kwargs', 0.35, 'p%'), (2, 1, 'model_registry', 'model_registry', 'vertex-ai', 0.85, null), (2, 1, 'training_run', 'training_run', 'gcp-vertex-ai', 0.85, null), (2, 2, 'experiment_tracker', 'experiment_tracker', 'wandb', 0.85, null), (2, 3, 'training_run', 'training_run', 'aws-sagemaker', 0.9, null)) t(v, line, name, component_type, framework, confidence, told))
select 'm' || k || '.py' as path, line + pad as line, name, component_type, framework, cast(confidence as double) as confidence, confidence < 0.6 as needs_agentic, replace(told, '%', k::varchar) as told from f join m using (v)""")
def lifecycle_assets(spark, d):
    k = F.col("p_partkey")
    text = F.concat(F.repeat(F.lit("\n"), (F.col("p_size") % 3).cast("int")), F.element_at(F.array(*(_filled(t, k=k) for t in _TRAINING)), (k % 3 + 1).cast("int")))
    files = _t(spark, d, "part").select(F.lit("r").alias("root"), F.concat(F.lit("m"), k.cast("string"), F.lit(".py")).alias("path"), text.alias("content"))
    return lifecycle.components(files).withColumn("told", F.coalesce("value", "storage_uri")).drop("root", "value", "storage_uri")
