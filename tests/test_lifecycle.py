"""The model life cycle: patterns by concept, worth by imports, hyperparameters."""

from inventra.operators import extract, lifecycle

#: path, content and what is found: line, name, framework, confidence, value or place.
CASES = [
    ("ml.py", "import torch\nfrom datasets import load_dataset\nd = load_dataset('x')\nt = Trainer(learning_rate=1e-4, fp16 = True)  # ok\nt.train()\ntorch.save(m, 's3://b/w.pt')\nbatch_size=32\n",
     {(2, "dataset", "huggingface/datasets", 0.85, None), (3, "dataset", "huggingface/datasets", 0.85, None), (4, "training_run", "huggingface/transformers", 0.9, None), (4, "hyperparameter:learning_rate", "python-kwargs", 0.85, "1e-4"), (4, "hyperparameter:fp16", "python-kwargs", 0.85, "True"),
      (5, "training_run", "pytorch", 0.9, None), (6, "model_artifact", "pytorch", 0.9, "s3://b/w.pt"), (6, "model_artifact", "cloud-storage", 0.9, "s3://b/w.pt"), (7, "hyperparameter:batch_size", "python-kwargs", 0.85, "32")}),
    ("plain.py", "import os\nx.fit(1)\nd = pd.read_csv('gs://b/t.csv')\nbatches = 1; my_dropout=1; dropout = 'high'\n@step\ndef f(): pass\ncreate_training_job(x)\nbatch_size=1\n",
     {(2, "training_run", "keras/pytorch", 0.3, None), (3, "dataset", "pandas", 0.3, "gs://b/t.csv"), (3, "dataset", "cloud-storage", 0.3, "gs://b/t.csv"), (4, "hyperparameter:dropout", "python-kwargs", 0.35, "high"), (5, "ml_pipeline", "zenml/metaflow", 0.5, None), (7, "training_run", "aws-sagemaker", 0.9, None), (8, "hyperparameter:batch_size", "python-kwargs", 0.35, "1")}),
    ("cloud.py", "from google.cloud import aiplatform\nmlflow.register_model(m)\nimport dvc.api\nwandb.init()\n", {(1, "model_registry", "vertex-ai", 0.85, None), (1, "training_run", "gcp-vertex-ai", 0.85, None), (2, "model_registry", "mlflow", 0.85, None), (2, "model_registry", "ml-registry", 0.85, None), (3, "data_versioning", "dvc", 0.85, None), (4, "experiment_tracker", "wandb", 0.85, None)}),
    ("conf/train.yaml", "data:\n  path: s3://b/x.parquet\nname: w\n", {(1, "dataset", "yaml-config", 0.85, None), (2, "dataset", "cloud-storage", 0.75, "s3://b/x.parquet")}),
    ("k8s.yaml", "kind: ConfigMap\ndata:\n  a: b\n", set()), ("api.yml", "openapi: 3\ndata:\n", set()), ("dvc.lock", "x", {(1, "data_versioning", "dvc", 0.85, None)}), ("pipeline.yml", "a: b\n", {(1, "ml_pipeline", "pipeline-config", 0.85, None)}),
    ("kf.yaml", "a: b\nx: pipelines.kubeflow.org/v1\ny: kubeflow.org\n", {(2, "ml_pipeline", "kubeflow", 0.85, None)}), ("air.yaml", "dag: x\nuse: Airflow\n", {(1, "ml_pipeline", "airflow", 0.85, None)}), ("argo.yaml", "apiVersion: argoproj.io/v1\n", {(1, "ml_pipeline", "argo", 0.75, None)}),
    (".github/workflows/ci.yml", "- run: aws s3 cp out/m.gguf s3://b\n- uses: actions/upload-artifact with m.csv\n  image: pytorch/pytorch:2\n", {(1, "model_artifact", "ci-cd", 0.85, None), (2, "model_artifact", "ci-cd", 0.85, None), (3, "training_run", "ci-cd", 0.85, None)}),
    ("x.ts", "model.save(1)\n", set()), ("empty.py", "", set()), ("nothing.py", "a = 1\n", set()),
]


def test_what_is_found(spark):
    files = spark.createDataFrame([("r", p, t) for p, t, _ in CASES] + [("r", "null.py", None)], "root string, path string, content string").repartition(3)
    got = {}
    for r in lifecycle.components(files).collect():
        got.setdefault(r.path, set()).add((r.line, r.name, r.framework, r.confidence, r.value or r.storage_uri))
        assert r.needs_agentic == (r.confidence <= 0.5)
    assert got == {p: want for p, _, want in CASES if want}
    assert extract.SCANNERS["ml_lifecycle"](files).columns == extract.COLUMNS and lifecycle.components(files.limit(0)).collect() == []
