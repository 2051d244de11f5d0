"""Infrastructure files: each shape, each rule, what doesn't count."""

import pytest

from inventra.operators import extract
from inventra.operators import infrastructure as I
from inventra.tables import stored

POD = "apiVersion: v1\nkind: {kind}\nspec:\n  template:\n    spec:\n      containers:\n"
#: path, content and what is found: line, name, type, model, confidence, variable, technology (the last as far as given).
CASES = [
    ("job.yaml", POD.format(kind="CronJob") + "      - image: my/pytorch-training\n        resources: {limits: {amd.com/gpu: 1}}\n", {(7, "training:job", "training_run")}),
    ("cpu.yaml", POD.format(kind="Job") + "      - image: my/pytorch-training\n        resources: {limits: {cpu: 1}}\n", set()),
    ("serve.yaml", POD.format(kind="Deployment") + "      - {name: a, image: my/pytorch}\n      - name: b\n        image: docker.io/vllm/vllm-openai:v1\n        resources: {limits: {nvidia.com/gpu: 1}}\n", {(9, "docker.io/vllm/vllm-openai:v1", "dependency")}),
    ("env.yaml", POD.format(kind="StatefulSet") + "      - env:\n        - {name: EMBEDDING_MODEL, value: x}\n        - name: MODEL_ENDPOINT\n          value: http://h/v1\n        - {name: OPENAI_API_BASE, value: https://weaviate.h}\n        - {name: HF_TOKEN}\n        - {name: MODEL_NAME, value: text-embedding-3-small}\n        - {name: LOG_LEVEL, value: gpt-4o}\n",
     {(8, "env:EMBEDDING_MODEL", "embedding", "x"), (9, "env:MODEL_ENDPOINT", "model_endpoint", "http://h/v1"), (11, "env:OPENAI_API_BASE", "vector_store", "https://weaviate.h"), (12, "env:HF_TOKEN", "secret"), (13, "env:MODEL_NAME", "embedding", "text-embedding-3-small")}),
    ("spec.yaml", "apiVersion: v1\nkind: Job\nspec:\n  spec:\n    initContainers:\n    - image: ollama/ollama\n", {(6, "ollama/ollama", "dependency")}),
    ("pod.yaml", "apiVersion: v1\nkind: Pod\nspec:\n  containers:\n  - image: ollama/ollama\n", set()),
    ("service.yaml", "apiVersion: v1\nkind: Service\nmetadata:\n  annotations:\n    m: gpt-4o\n    n: web\n  labels: {x: gpt-4o}\n", {(5, "gpt-4o", "model", "gpt-4o", 0.95)}),
    ("config.yaml", "apiVersion: v1\nkind: ConfigMap\ndata:\n  OPENAI_API_KEY: s\n  LLM_MODEL: gpt-4o\n  n: 5\n---\napiVersion: v1\nkind: Secret\nstringData: {other: claude-3-opus-20240229}\n",
     {(4, "env:OPENAI_API_KEY", "secret"), (5, "env:LLM_MODEL", "model", "gpt-4o"), (5, "gpt-4o", "model", "gpt-4o", 0.95), (10, "claude-3-opus-20240229", "model", "claude-3-opus-20240229", 0.95)}),
    ("h/values-prod.yaml", "a:\n  tag: gpt-4o\n  items: [gpt-4o, {model: gpt-4o-mini}]\n  chat-model: mine\n  api_url: http://x\n  base_url: ftp://x\nb:\n  gpu: 0\n  embedding_model: e-1\n  provider: claude-3-opus-20240229\n  endpoint: http://y\nc:\n  provider: qdrant\n  pinecone_base_url: https://p\n",
     {(3, "gpt-4o-mini", "model", "gpt-4o-mini", 0.95), (4, "mine", "model", "mine", 0.5), (5, "http://x", "llm_endpoint", None, 0.5, "api_url"), (9, "e-1", "embedding", "e-1", 0.5), (10, "claude-3-opus-20240229", "model", "claude-3-opus-20240229", 0.95), (11, "http://y", "llm_endpoint", None, 0.5, "endpoint"), (14, "https://p", "vector_store", None, 0.5, "pinecone_base_url", "qdrant")}),
    ("c/Chart.yaml", "name: c\n", set()), ("c/templates/sub/a.yaml", "env:\n  - name: FIRST\n    value: {{ .Values.llm.model }}\n  - name: \"URL\"\n    value: {{ .Values.llm.endpoint | quote }}\n", set()), ("c/templates/z.yaml", "  - name: LAST\n    value: x-{{ .Values.llm.model }}\n", set()),
    ("c/env/dev/values.yaml", "llm:\n  model: gpt-4o\n  endpoint: https://api.openai.com\n", {(2, "gpt-4o", "model", "gpt-4o", 0.95, "LAST"), (3, "https://api.openai.com", "llm_endpoint", None, 0.5, "URL")}),
    ("main.tf", 'resource "azurerm_cognitive_account" "a" {\n  tags = {\n    model_name = "m-1"\n  }\n}\nresource "aws_s3_bucket" "b" {\n  model_id = "no"\n  instance_type = "ml.p3.2xlarge"\n}\nvariable "i" { default = "localai/localai:1" }\nlocals {\n  llm = "gpt-4o"\n  other = "gpt-4o"\n  gpu = "x"\n}\n',
     {(1, "azurerm_cognitive_account.a", "other"), (3, "m-1", "model", "m-1"), (10, "localai/localai:1", "dependency"), (12, "gpt-4o", "model", "gpt-4o", 0.95)}),
    ("stack.json", '{"Resources": {"E": {"Type": "AWS::Bedrock::Agent", "Properties": {"List": [{"ModelId": "mine"}], "InstanceType": "t3"}}}, "Parameters": {"P": {"Default": "gpt-4o"}, "Q": {"Default": 5}}}', {(1, "E", "other"), (1, "mine", "model", "mine"), (1, "gpt-4o", "model", "gpt-4o", 0.95)}),
    ("arm.json", '{"$schema": "https://s/deploymentTemplate.json", "resources": [{"type": "Microsoft.CognitiveServices/accounts@1", "properties": {"deployments": [{"model": {"format": "gpt-4o"}}, {"model": {"name": "mine", "format": "gpt-4o-mini"}}]}}, {"type": "Microsoft.Web/sites", "name": "w", "properties": {"sku": {"name": "Standard_NC6"}}}]}', {(1, "resource", "other"), (1, "gpt-4o", "model", "gpt-4o", 0.95)}),
    ("a.bicep", "resource a 'Microsoft.MachineLearningServices/workspaces@2023-01' = {}\nresource b 'Microsoft.Web/sites@1' = {}\nparam m string = 'gpt-4o'\nparam n string = 'v1.2'\n", {(1, "Microsoft.MachineLearningServices/workspaces", "other"), (3, "gpt-4o", "model", "gpt-4o", 0.95)}),
    ("plain.yaml", "model: gpt-4o\n", set()), ("broken.yaml", "apiVersion: [\nkind: x\n", set()), ("broken.json", "{", set()), ("empty.yaml", "", set()), ("loop.yaml", "apiVersion: v1\nkind: &a [*a]\n", set()), ("number.json", "5", set()),
]


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([("r", p, t) for p, t, _ in CASES] + [("r", "null.tf", None)], "root string, path string, content string").repartition(3)
    out = {}
    for r in I.components(files).collect():
        out.setdefault(r.path, []).append((r.line, r.name, r.component_type, r.model_name, r.confidence, r.env_var, r.technology))
    return out, files


@pytest.mark.parametrize(("path", "want"), [(p, w) for p, _, w in CASES], ids=[p for p, *_ in CASES])
def test_found(found, path, want):
    got = sorted(found[0].get(path, []))
    told = sorted(want)
    assert [g[: len(w)] for g, w in zip(got, told, strict=False)] == told and len(got) == len(told)


def test_scanner(found):
    rows = extract.SCANNERS["infrastructure"](found[1])
    assert rows.columns == extract.COLUMNS and rows.where("path = 'stack.json'").count() == 3


def test_no_files(spark):
    assert I.components(spark.createDataFrame([], "root string, path string, content string")).collect() == []


def test_documents_are_read_by_the_parser_in_c(monkeypatch):
    """Same documents as the plain parser's, which takes several times as long and isn't asked."""
    import yaml

    from inventra.sources.files import yaml_documents

    texts = ["a: 1\n---\n---\nb: [x, 1.5, no, ~, 2020-01-02]\n", "a: &x {k: 'v'}\nb: *x\nc: |\n  t\n  u\n", "", "- \"\\u00e9\"\n- {a: {}}\n"]
    plain = [[x for x in yaml.safe_load_all(t) if x is not None] for t in texts]
    monkeypatch.setattr(yaml.SafeLoader, "__init__", lambda *a: 1 / 0)
    assert [yaml_documents(t) for t in texts] == plain


def test_files_are_read_once_and_rules_share_passes(spark):
    """What grows with the files: one pass of Python in all, no join for the registry's patterns, and one pass over rows for rules of the same rows."""
    from unittest import mock

    files, made = spark.createDataFrame([("r", "a.yaml", "x: 1\n")], "root string, path string, content string"), []

    def keep(df):
        made.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df)

    with mock.patch.object(I, "stored", keep):
        plan = I.components(files)._jdf.queryExecution().executedPlan().toString()
    assert len(made) == 1 and made[0].count("MapInArrow") == 1 and "Join" not in made[0]
    assert "MapInArrow" not in plan and plan.count("Generate inline") <= 12
