"""The life cycle of models in code, pipelines and configuration: data, training,
artifacts, trackers, registries, versions of data, orchestration, hyperparameters.

Files are taken apart into lines once; a line is tested by one pattern made of all,
and only lines that it fits meet the table of patterns.  What a match is worth
depends on what its file imports."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inventra.functions.text import stripped
from inventra.operators.extract import COLUMNS, imports_any, imports_family, python_files, scanner
from inventra.sources.files import extension, spread

_WEIGHTS = "safetensors|gguf|onnx|h5|pb|tflite|mlmodel|pt|pth"
_TABLES = "csv|parquet|jsonl|tfrecord"
# Concepts with patterns and parts of import lines, each with its framework, in order.
PATTERNS = (
    ("dataset", ((r"\bload_dataset\s*\(", "huggingface/datasets"), (r"\bpd\.read_csv\s*\(", "pandas"), (r"\bpd\.read_parquet\s*\(", "pandas"), (r"\btf\.data\.Dataset\b", "tensorflow"), (r"\btorch\.utils\.data\.DataLoader\b", "pytorch"), (r"\bDataLoader\s*\(", "pytorch"), (r"\bImageFolder\s*\(", "torchvision"), (r"\bload_from_disk\s*\(", "huggingface/datasets"), (rf"(?i)(?:s3|gs)://[^\s\"']+\.(?:{_TABLES})\b", "cloud-storage"), (rf"(?i)https?://[^\s\"']*\.blob\.core\.windows\.net[^\s\"']*\.(?:{_TABLES})\b", "azure-blob")),
     (("from datasets import", "huggingface/datasets"), ("import datasets", "huggingface/datasets"))),
    ("training_run", ((r"\bTrainer\s*\(", "huggingface/transformers"), (r"\.fit\s*\(", "keras/pytorch"), (r"\.train\s*\(", "pytorch"), (r"\bmodel\.compile\s*\(", "tensorflow/keras"), (r"\bAccelerator\s*\(", "huggingface/accelerate"), (r"\btrainer\.train\s*\(", "huggingface/transformers"), (r"\btraining_args\s*=", "huggingface/transformers"), (r"\bTrainingArguments\s*\(", "huggingface/transformers"), (r"\bAdam\s*\(", "pytorch/tensorflow"), (r"\bSGD\s*\(", "pytorch/tensorflow"), (r"\bAdamW\s*\(", "pytorch/tensorflow"), (r"\blr_scheduler\b", "pytorch/tensorflow")), ()),
    ("model_artifact", ((rf"(?i)(?:s3|gs)://[^\s\"']+\.(?:{_WEIGHTS})\b", "cloud-storage"), (rf"(?i)https?://[^\s\"']*\.blob\.core\.windows\.net[^\s\"']*\.(?:{_WEIGHTS})\b", "azure-blob"), (r"(?i)(?:model|weights|checkpoint|pretrained|lfs).{0,160}\.bin\b", "model-weights"),
        *((rf"(?<![A-Za-z0-9_])\.{end}\b", kind) for end, kind in (("safetensors", "safetensors"), ("gguf", "gguf"), ("onnx", "onnx"), ("h5", "keras"), ("pb", "tensorflow"), ("tflite", "tensorflow"), ("pth", "pytorch"), ("pt", "pytorch"), ("mlmodel", "coreml"))),
        (r"\bmodel\.save\s*\(", "keras/tensorflow"), (r"\btorch\.save\s*\(", "pytorch"), (r"\bmodel\.save_pretrained\s*\(", "huggingface/transformers"), (r"\btf\.saved_model\.save\s*\(", "tensorflow"), (r"\bexport_to_onnx\s*\(", "onnx")), ()),
    ("experiment_tracker", ((r"\bwandb\.(init|log)\s*\(", "wandb"), (r"\bmlflow\.(start_run|log_metric|log_param|autolog|set_tag)\s*\(", "mlflow"), (r"\bneptune\.(init_run|Run)\s*\(", "neptune"), (r"\bcomet_ml\.Experiment\s*\(", "comet_ml"), (r"\bSummaryWriter\s*\(", "tensorboard"), (r"\btorch\.utils\.tensorboard\b", "tensorboard"), (r"\bclearml\.(Task|Logger)\b", "clearml"), (r"\btrackio\b", "trackio"), (r"\bswanlab\.(init|log)\s*\(", "swanlab")),
     (("import wandb", "wandb"), ("import mlflow", "mlflow"), ("from mlflow", "mlflow"), ("import comet_ml", "comet_ml"), ("from comet_ml", "comet_ml"), ("import neptune", "neptune"), ("from neptune", "neptune"))),
    ("model_registry", ((r"\bmlflow\.register_model\s*\(", "mlflow"), (r"\bregister_model\s*\(", "ml-registry"), (r"\bcreate_model_version\s*\(", "model-registry"), (r"\btransition_model_version_stage\s*\(", "mlflow"), (r"\bModelRegistry\b", "model-registry"), (r"\bupload_model_version\s*\(", "vertex-ai"), (r"\bModelVersion\s*\(", "model-registry")), (("from azure.ai.ml.entities import Model", "azure-ml"), ("from google.cloud import aiplatform", "vertex-ai"))),
    ("data_versioning", ((r"\bdvc\.(pull|push|repro|status)\s*\(", "dvc"), (r"\bdvc\.api\.", "dvc")), (("import dvc", "dvc"), ("from dvc", "dvc"))),
    ("ml_pipeline", ((r"@dsl\.pipeline\b", "kubeflow"), (r"@kfp\.dsl\.pipeline\b", "kubeflow"), (r"@component\b", "kubeflow/zenml"), (r"@step\b", "zenml/metaflow"), (r"@task\b", "prefect/airflow"), (r"\bfrom airflow import DAG\b", "airflow"), (r"\bwith\s+DAG\s*\(", "airflow"), (r"\bfrom airflow\.decorators import\b", "airflow"), (r"\bfrom zenml import step\b", "zenml"), (r"\bfrom metaflow import\b", "metaflow"), (r"\bfrom prefect import flow\b", "prefect"), (r"\bPipelineJob\b", "vertex-ai"), (r"apiVersion:\s*argoproj\.io", "argo")), (("from kfp import dsl", "kubeflow"), ("from kfp.dsl import", "kubeflow"))),
    ("training_run", ((r"boto3\.client\s*\(\s*[\"']sagemaker[\"']\s*\)", "aws-sagemaker"), (r"\bcreate_training_job\s*\(", "aws-sagemaker"), (r"\bcreate_endpoint_config\s*\(", "aws-sagemaker"), (r"\bSageMaker(?:Estimator|Processor|Pipeline)\s*\(", "aws-sagemaker"), (r"\bHuggingFace(?:Processor|Model|Estimator)\s*\(", "aws-sagemaker"), (r"\bCustomJob\s*\(", "gcp-vertex-ai"), (r"\baiplatform\.(?:init|CustomJob|AutoMLTabularTrainingJob)\s*\(", "gcp-vertex-ai"), (r"(?i)\bcommand_job\s*=\s*command\s*\(", "azure-ml"), (r"\bml_client\.(?:jobs\.create_or_update|compute\.begin_create_or_update)\s*\(", "azure-ml")),
     (("from sagemaker import", "aws-sagemaker"), ("import sagemaker", "aws-sagemaker"), ("from sagemaker.huggingface import", "aws-sagemaker"), ("from google.cloud import aiplatform", "gcp-vertex-ai"), ("from azure.ai.ml import command", "azure-ml"), ("from azure.ai.ml import MLClient", "azure-ml"))),
)
# Hyperparameters; one counts only where the file trains.
HYPERPARAMETERS = ("learning_rate", "num_epochs", "warmup_steps", "weight_decay", "max_seq_length", "gradient_accumulation_steps", "fp16", "bf16", "dropout")
TRAINS = r"(?i)(?:Trainer|TrainingArguments|DataLoader|fit|train)"
CLOUD = ("aws-sagemaker", "gcp-vertex-ai", "azure-ml")
UNSURE_DATA = ("pandas", "cloud-storage", "azure-blob")
# Lines of CI files that move weights or train in an image; kinds of Kubernetes.
MOVES = rf"(?i)(?:(?:s3|aws)\s+cp|gsutil\s+cp)\s+[^\n]*\.(?:{_WEIGHTS}|bin)\b|(?:upload-artifact|artifacts?:|archiveartifacts)\s*[^\n]*(?:safetensors|gguf|\.pt\b|\.pth\b|onnx|\.h5\b|\.pb\b|tflite|\.bin\b|mlmodel|\.parquet|\.csv)"
IMAGE = r"(?i)(?:image:\s*[\"']?|docker://|docker\.io/)(?:tensorflow/tensorflow|pytorch/pytorch|nvidia/cuda|huggingface/|ghcr\.io/huggingface)"
KUBERNETES = r"(?m)^\s*kind:\s*(ConfigMap|Secret|Deployment|StatefulSet|DaemonSet|Service|Ingress|Job|CronJob|ServiceAccount|Role|RoleBinding|ClusterRole|ClusterRoleBinding|PersistentVolumeClaim|HorizontalPodAutoscaler)\s*$"

_TABLE = [(concept, framework, pattern, imported, n) for n, (concept, framework, pattern, imported) in enumerate((c, f, p, i) for c, patterns, imports in PATTERNS for i, group in ((True, imports), (False, patterns)) for p, f in group)]
_CASED = re.compile(r"\(\?i\)")


def _any(patterns: list[str]) -> str:
    """One pattern that fits where any does; flags stay with their own part."""
    return "|".join(f"(?i:{_CASED.sub('', p)})" if p.startswith("(?i)") else f"(?:{p})" for p in patterns)


_ALL = _any([re.escape(p) if imported else p for _, _, p, imported, _ in _TABLE])


def _lines(files: DataFrame) -> DataFrame:
    """root, path, line, text and what the file is and imports, for each line of
    Python, YAML and CI files."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    other = files.where((extension() != ".py") & (extension() != ".ipynb")).select("root", "path", "content")
    own = python_files(files).withColumn("python", F.lit(True)).unionByName(other.withColumn("python", F.lit(False)))
    ci = (F.col("path").rlike(r"^\.github/workflows/") & name.rlike(r"\.ya?ml$")) | name.isin(".gitlab-ci.yml", "jenkinsfile")
    yaml = extension().isin(".yaml", ".yml")
    own = own.withColumns({"ci": ci, "yaml": yaml}).where(F.col("python") | F.col("ci") | F.col("yaml"))
    of = lambda family: F.col("python") & imports_family(F.col("content"), family)
    own = own.withColumns({"ml": of("ml"), "data": of("data"), "ai": F.col("python") & imports_any(F.col("content")), "trains": F.col("content").rlike(TRAINS), "plain": ~F.col("content").rlike(KUBERNETES) & ~F.substring("content", 1, 2000).rlike(r"(?m)^\s*(?:openapi|swagger)\s*:")})
    flags = ["python", "ci", "yaml", "ml", "data", "ai", "trains", "plain"]
    return own.select("root", "path", *flags, F.posexplode(F.split("content", r"\r?\n")).alias("_i", "text")).withColumn("line", (F.col("_i") + 1).cast("int"))


def _worth() -> tuple[Column, Column]:
    """Confidence, and whether a match waits for review, by concept and imports."""
    c, f, ml = F.col("concept"), F.col("framework"), F.col("ml")
    unsure = F.when((c == "training_run") & ~f.isin(*CLOUD) & ~ml, 0.3).when((c == "dataset") & ~ml & ~F.col("data") & f.isin(*UNSURE_DATA), 0.3).when((c == "ml_pipeline") & ~ml & ~F.col("ai"), 0.5)
    sure = F.when(c == "training_run", 0.9).when((c == "dataset") & ~ml & ~F.col("data"), 0.7).when(c.isin("model_artifact", "data_versioning"), 0.9).otherwise(0.85)
    code = F.col("python") & ~F.col("imported")
    return F.when(F.col("imported"), 0.85).when(code, F.coalesce(unsure, sure)).otherwise(0.75), code & unsure.isNotNull()


_OUT = ["root", "path", "line", "name", "component_type", "framework", "confidence", "needs_agentic", "storage_uri", "value"]


def _told(rows: DataFrame, kind: str, framework: str, line: Column | None = None, uri: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select("root", "path", (F.col("line") if line is None else line).cast("int").alias("line"), F.lit(kind).alias("name"), F.lit(kind).alias("component_type"), F.lit(framework).alias("framework"), F.lit(0.85).alias("confidence"), F.lit(False).alias("needs_agentic"), (none if uri is None else uri).alias("storage_uri"), none.alias("value"))


def _uri() -> Column:
    found = F.regexp_extract("text", r"(?i)((?:s3|gs)://[^\s\"'<>]+|https?://[^\s\"'<>]+)", 1)
    return F.nullif(F.regexp_replace(found, r"[).,;\]}'\"]+$", ""), F.lit(""))


def components(files: DataFrame) -> DataFrame:
    """root, path, line, name, component_type, framework, confidence,
    needs_agentic, storage_uri, and of a hyperparameter its value: one row for each
    line, type and framework, the first by order of the table."""
    files = spread(files.select("root", "path", "content"))
    lines = _lines(files)
    fields = ("concept", "framework", "pattern", "imported", "n")
    table = F.array(*(F.struct(*(F.lit(v).alias(f) for f, v in zip(fields, row, strict=True))) for row in _TABLE))
    hit = F.filter(table, lambda x: F.when(x["imported"], F.contains("text", x["pattern"])).otherwise(F.rlike("text", x["pattern"])))
    met = lines.where(F.col("text").rlike(_ALL)).withColumn("hit", F.explode(hit)).select("*", *(F.col(f"hit.{f}").alias(f) for f in fields if f != "pattern"))
    confidence, review = _worth()
    uri = F.when(~F.col("imported") & F.col("concept").isin("dataset", "model_artifact"), _uri())
    named = met.select("root", "path", "line", "n", F.col("concept").alias("name"), F.col("concept").alias("component_type"), "framework", confidence.alias("confidence"), review.alias("needs_agentic"), uri.alias("storage_uri"), F.lit(None).cast("string").alias("value"))

    key = F.explode(F.array(*map(F.lit, (*HYPERPARAMETERS, "batch_size"))))
    h = lines.where(F.col("python") & F.contains("text", F.lit("="))).where(F.col("text").rlike(r"\b(?:" + "|".join((*HYPERPARAMETERS, "batch_size")) + r")\s*=")).withColumn("key", key)
    h = h.where((F.col("key") != "batch_size") | F.col("trains")).withColumn("raw", F.explode(F.regexp_extract_all("text", F.concat(F.lit(r"\b"), "key", F.lit(r"\s*=\s*([^,\n#)]+)")), F.lit(1))))
    value = stripped(F.col("raw"))
    value = F.when(value.rlike(r"^\".*\"$|^'.*'$") & (F.length(value) > 1), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    given = h.select("root", "path", "line", F.concat(F.lit("hyperparameter:"), "key").alias("name"), F.lit("hyperparameter").alias("component_type"), F.lit("python-kwargs").alias("framework"), F.when(F.col("ml"), 0.85).otherwise(0.35).alias("confidence"), (~F.col("ml")).alias("needs_agentic"), F.lit(None).cast("string").alias("storage_uri"), value.alias("value")).distinct()

    name = F.lower(F.element_at(F.split("path", "/"), -1))
    low = F.lower(F.coalesce("content", F.lit("")))
    yaml = files.where(extension().isin(".yaml", ".yml"))
    kubeflow = lines.where("yaml and contains(text, 'kubeflow.org')").groupBy("root", "path").agg(F.min("line").alias("line"))
    head = F.lower(F.array_join(F.slice(F.split("content", "\n"), 1, 50), "\n"))
    airflow = yaml.where(F.contains(low, F.lit("dag")) & F.contains(head, F.lit("airflow")))
    one = F.lit(1)
    whole = [
        _told(files.where(name.isin("dvc.yaml", "dvc.lock") | name.endswith(".dvc")), "data_versioning", "dvc", one), _told(files.where(name.isin("pipeline.yaml", "pipeline.yml")), "ml_pipeline", "pipeline-config", one),
        _told(kubeflow, "ml_pipeline", "kubeflow"), _told(airflow, "ml_pipeline", "airflow", one), _told(lines.where(F.col("yaml") & F.col("plain") & F.col("text").rlike(r"^\s*data:\s*(?:#.*)?$")), "dataset", "yaml-config", uri=_uri()),
        _told(lines.where(F.col("ci") & F.col("text").rlike(MOVES)), "model_artifact", "ci-cd"), _told(lines.where(F.col("ci") & F.col("text").rlike(IMAGE)), "training_run", "ci-cd"),
    ]
    every = reduce(DataFrame.unionByName, [named, *(w.withColumn("n", F.lit(-1)) for w in whole)])
    rest = [c for c in _OUT if c not in ("root", "path", "line", "component_type", "framework")]
    best = every.groupBy("root", "path", "line", "component_type", "framework").agg(F.min_by(F.struct(*rest), "n").alias("m"))
    return best.select("root", "path", "line", "component_type", "framework", "m.*").select(*_OUT).unionByName(given.select(*_OUT))


@scanner("ml_lifecycle")
def lifecycle_components(files: DataFrame) -> DataFrame:
    return components(files).withColumn("model_name", F.lit(None).cast("string")).withColumn("scanner", F.lit("ml_lifecycle")).select(*COLUMNS)
