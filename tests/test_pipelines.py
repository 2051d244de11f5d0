"""CI files: what each rule finds, and what it leaves."""

from inventra.operators import extract, pipelines

HUB, LAB = ".github/workflows/", ".gitlab-ci.yml"
#: path, content and what is found: line, name, type, framework, confidence, job.
CASES = [
    (HUB + "image.yml", "jobs:\n  a:\n    container: ollama/ollama:1\n  b:\n    container: {image: node, env: {X: vllm}}\n  c:\n    services: {d: {image: vllm}}\n", {(0, "ollama/ollama:1", "dependency", "docker", 1.0, "a")}),
    (HUB + "uses.yaml", "jobs:\n  a:\n    steps:\n    - uses: huggingface/x@v1\n    - uses: actions/checkout@v4\n    - uses: google-github-actions/setup-gcloud@main\n", {(0, "huggingface/x", "dependency", "github_actions", 1.0, "a"), (0, "google-github-actions/setup-gcloud", "dependency", "github_actions", 1.0, "a")}),
    (HUB + "run.yml", "jobs:\n  a:\n    steps:\n    - run: python -m torch\n    - {name: tune, run: fine-tune x}\n    - {name: no, run: retrain_all}\n    - {name: torch, with: {run: torch}}\n", {(0, "AI-related step", "ml_pipeline", "", 1.0, "a"), (0, "tune", "training_run", "", 1.0, "a")}),
    (HUB + "model.yml", "jobs:\n  a:\n    steps:\n    - run: echo model=gpt4 MODEL=a/b model_id:'x-1' --model=org/m2\n      with: {model: c-3, text: \"model: d-4\"}\n    env: {MODEL: \"model=e-5\"}\n",
     {(0, "a/b", "model", "", 0.5, "a"), (0, "x-1", "model", "", 0.5, "a"), (0, "org/m2", "model", "", 0.5, "a"), (0, "d-4", "model", "", 0.5, "a")}),
    (HUB + "env.yml", "jobs:\n  a:\n    steps:\n    - env:\n        A: ${{ secrets.A || 'gpt-4o' }}\n        B: ${{ secrets.B || 'nothing here' }}\n        C: ${{ secrets.OPENAI_API_KEY }} # OPENAI_API_KEY MY_OPENAI_API_KEY\n", {(0, "gpt-4o", "model", "", 0.7, "a"), (7, "OPENAI_API_KEY", "secret", "", 1.0, None)}),
    (HUB + "none.yml", "on: push\n# OPENAI_API_KEY\n", set()), (HUB + "odd.yml", "jobs: [OPENAI_API_KEY]\n", set()), (HUB + "broken.yml", "jobs: [\n", set()), (HUB + "empty.yml", "", set()), ("other.yml", "jobs:\n  a:\n    container: ollama\n", set()),
    (LAB, "image: ollama\ndefault: {image: vllm}\na:\n  image: mlflow/x\n  script: [ls, evaluate it, train it]\n  after_script: [train it]\nb:\n  image: {name: bentoml/y}\n  script: torch\n.c: {image: vllm, script: [torch]}\n# HF_TOKEN\n",
     {(0, "mlflow/x", "dependency", "docker", 1.0, "a"), (0, "a", "ml_pipeline", "", 1.0, "a"), (0, "a", "training_run", "", 1.0, "a"), (0, "bentoml/y", "dependency", "docker", 1.0, "b"), (11, "HF_TOKEN", "secret", "", 1.0, None)}),
]


def test_what_is_found(spark):
    files = spark.createDataFrame([("r", p, t) for p, t, _ in CASES] + [("r", "sub/.github/workflows/null.yml", None)], "root string, path string, content string").repartition(3)
    got = {}
    for r in pipelines.components(files).collect():
        got.setdefault(r.path, set()).add((r.line, r.name, r.component_type, r.framework, r.confidence, r.job))
    assert got == {p: want for p, _, want in CASES if want}
    assert extract.SCANNERS["pipelines"](files).columns == extract.COLUMNS
    assert pipelines.components(files.limit(0)).collect() == []


def test_known_models_need_no_join(spark):
    """Names of models are told by patterns alone: the one join is that of steps with their names."""
    files = spark.createDataFrame([(p, t) for p, t, _ in CASES], "path string, content string").selectExpr("'r' as root", "*")
    assert pipelines.components(files)._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") <= 1


def test_all_rules_share_one_pass(spark):
    """One exchange spreads the files; what is found needs no other, no join and no second pass."""
    files = spark.createDataFrame([(p, t) for p, t, _ in CASES], "path string, content string").selectExpr("'r' as root", "*")
    plan = pipelines.components(files)._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("Exchange"), plan.count("MapInArrow"), plan.count("Join"), plan.count("FileScan")) == (1, 1, 0, 0)


def test_jobs_that_are_texts_and_keys_given_twice(spark):
    texts = [
        (HUB + "text.yml", "jobs: {a: torch, b: {steps: torch}, c: {container: vllm}}\n"), (HUB + "list.yml", "jobs: {}\njobs: [torch]\njobs: torch\n"),
        (HUB + "twice.yml", "jobs:\n  a:\n    steps:\n    - {name: x, run: torch, name: y}\n  a:\n    steps:\n    - run: train\n"),
        (LAB, "a:\n  script: [ls, dvc pull]\na:\n  script: [train]\n  before_script: {'[x': train}\nb: torch\nc: [vllm]\n"),
    ]
    files = spark.createDataFrame(texts, "path string, content string").selectExpr("'r' as root", "*")
    got = sorted((r.path, r.name, r.component_type, r.job) for r in pipelines.components(files).collect())
    steps = [(HUB + "twice.yml", name, kind, "a") for name in ("x", "y") for kind in ("ml_pipeline", "training_run")]
    assert got == sorted([(HUB + "text.yml", "vllm", "dependency", "c"), *steps, (LAB, "a", "ml_pipeline", "a"), (LAB, "a", "training_run", "a")])


def test_models_of_a_registry(spark):
    files = spark.createDataFrame([("r", p, t) for p, t, _ in CASES if p == HUB + "env.yml"], "root string, path string, content string")
    models = spark.createDataFrame([("nothing here", "own", "chat", False, 0)], "model string, provider string, mode string, deprecated boolean, ord int")
    got = {(r.name, r.component_type, r.model_name, r.needs_agentic) for r in pipelines.components(files, models).collect()}
    assert got == {("gpt-4o", "model", "gpt-4o", True), ("nothing here", "model", "nothing here", True), ("OPENAI_API_KEY", "secret", None, False)}
