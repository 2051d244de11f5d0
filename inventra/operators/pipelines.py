"""What CI pipelines run: images, actions, steps that train or serve, models that
they name, and keys of providers.  Like infrastructure, files are read into leaves
once, and rules are selections of them."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inventra.functions.registry import lookup
from inventra.operators.extract import COLUMNS, scanner
from inventra.operators.infrastructure import LOADER, leaves_of
from inventra.sources.files import parsed
from inventra.tables import stored

# Beginnings of actions; images, words of steps, words of training; keys of providers; what isn't a job.
ACTIONS = ("huggingface/", "aws-actions/amazon-sagemaker-", "google-github-actions/setup-gcloud", "azure/ml-", "iterative/setup-dvc", "iterative/cml", "bentoml/", "mlflow/")
IMAGES = r"(?i)(huggingface|sagemaker|vllm|tritonserver|tensorflow/serving|pytorch/pytorch|nvcr\.io/nvidia|ollama|bentoml|mlflow)"
STEPS = r"(?i)\b(train|finetune|fine.tune|evaluate|deploy.model|inference|sagemaker|bedrock|vertex.ai|openai|anthropic|huggingface|mlflow|wandb|dvc|bentoml|triton|vllm|ollama|transformers|torch|tensorflow|keras)\b"
TRAINS = r"(?i)\b(train|finetune|fine.tune)\b"
KEYS = ("OPENAI_API_KEY", "ANTHROPIC_API_KEY", "HUGGINGFACE_TOKEN", "HF_TOKEN", "AWS_ACCESS_KEY", "AZURE_OPENAI_KEY", "GOOGLE_API_KEY", "COHERE_API_KEY", "WANDB_API_KEY", "MLFLOW_TRACKING_TOKEN")
NO_JOBS = ("stages", "variables", "default", "include", "workflow")
SCRIPTS = ("script", "before_script", "after_script")
_MODEL = r"\b(?:model|model_name|model_id|MODEL)\s*[:=]\s*['\"]?([a-zA-Z0-9_./-]+)"
_DEFAULT = r"\$\{\{\s*secrets\.\w+\s*\|\|\s*'([^']+)'\s*\}\}"
_KEY = re.compile(r"\b(" + "|".join(KEYS) + r")\b")
LEAVES = "system string, kind string, at array<string>, value string, line int, beside array<string>"


def leaves(files: DataFrame) -> DataFrame:
    """system (actions or jobs), kind (leaf, script for all of a job's script, or key for
    a provider's key anywhere in the file), path, value, line, and what stands beside it
    in the file: of what a step runs the step's names, of a script its lines."""
    def parse(root: str, path: str, content: str) -> Iterator[tuple]:
        node = next(iter(yaml.compose_all(content, Loader=LOADER)), None)
        if isinstance(node, yaml.MappingNode):
            system = "jobs" if path.rsplit("/", 1)[-1] == ".gitlab-ci.yml" else "actions"
            held = [(at, value, line) for at, value, kind, line in leaves_of(node, ()) if kind == "text"]
            # Keys are looked for where there are jobs at all.
            if system == "jobs" or any(k.value == "jobs" and isinstance(v, yaml.MappingNode) for k, v in node.value):
                names, scripts = defaultdict(list), defaultdict(list)
                for at, value, _ in held:
                    if system == "actions" and len(at) == 5 and at[4] == "name":
                        names[at[:4]].append(value)
                    elif system == "jobs" and len(at) == 3 and at[1] in SCRIPTS and at[2].startswith("["):
                        scripts[at[:2]].append(value)
                yield from ((system, "leaf", at, value, line, names[at[:4]] if at[-1] == "run" else None) for at, value, line in held)
                yield from ((system, "script", at, None, 0, lines) for at, lines in scripts.items())
                line, past = 1, 0
                for m in _KEY.finditer(content):
                    line, past = line + content.count("\n", past, m.start()), m.start()
                    yield system, "key", (), m[1], line, None

    def read(*file: str) -> list[tuple]:
        try:
            return list(parse(*file))
        except yaml.YAMLError:
            return []

    return parsed(files.where(F.col("path").rlike(r"(^|/)(\.github/workflows/.*\.ya?ml|\.gitlab-ci\.yml)$")), read, LEAVES)


_OUT = ["line", "name", "component_type", "framework", "model_name", "confidence", "needs_agentic", "job", "asked"]


def _told(name: Column, kind: Column | str, framework: str = "", model: bool = False, confidence: float = 1.0, line: Column | int = 0, job: Column | None = None, asked: bool = False) -> Column:
    """A component; asked: only if the registry knows it."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    none = F.lit(None).cast("string")
    values = [lit(line), name, lit(kind), F.lit(framework), name if model else none, F.lit(confidence), F.lit(model), none if job is None else job, F.lit(asked)]
    return F.struct(*(v.alias(c) for v, c in zip(values, _OUT, strict=True)))


def components(files: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """root, path, line, name, component_type, framework, model_name, confidence,
    needs_agentic, job.  Only keys have a line.  What rules need of a file stands in one
    row, so all of them share one pass, and nothing is stored or joined but a registry's table."""
    rows = leaves(files)
    at, value, beside, n = F.col("at"), F.col("value"), F.col("beside"), F.size("at")
    place = lambda i: F.get(at, F.lit(i))
    kind = lambda c: F.when(c.rlike(TRAINS), "training_run").otherwise("ml_pipeline")

    # Rules of actions: of a job's leaves, and of those in its steps.
    job = place(1)
    action = F.expr("system = 'actions' and kind = 'leaf'") & (place(0) == "jobs")
    container = (F.slice(at, 3, 9) == F.array(F.lit("container"))) | (F.slice(at, 3, 9) == F.array(F.lit("container"), F.lit("image")))
    step = action & (place(2) == "steps") & (n > 4)
    field = lambda name: step & (n == 5) & (place(4) == name)
    uses = field("uses") & reduce(Column.__or__, [value.startswith(p) for p in ACTIONS])
    called = F.when(F.size(beside) > 0, beside).otherwise(F.array(F.lit("AI-related step")))
    named = F.filter(F.regexp_extract_all(value, F.lit(_MODEL), 1), lambda m: m.contains("-") | (m.contains("/") & (F.length(m) >= 3)))
    given = F.trim(F.regexp_extract(value, _DEFAULT, 1))

    # Rules of jobs; the first line of each script that says what a job is for counts.
    own = place(0)
    is_job = (F.col("system") == "jobs") & ~own.startswith(".") & ~own.isin(*NO_JOBS)
    image = (F.slice(at, 2, 9) == F.array(F.lit("image"))) | (F.slice(at, 2, 9) == F.array(F.lit("image"), F.lit("name")))
    first = F.get(F.filter(beside, lambda x: x.rlike(STEPS)), F.lit(0))
    script = F.when(is_job & (F.col("kind") == "script"), first)

    one = [
        F.when(F.col("kind") == "key", _told(value, "secret", line=F.col("line"))),
        F.when(action & container & value.rlike(IMAGES), _told(value, "dependency", "docker", job=job)),
        F.when(uses, _told(F.split_part(value, F.lit("@"), F.lit(1)), "dependency", "github_actions", job=job)),
        F.when(step & (n == 6) & (place(4) == "env") & (F.length(given) >= 3), _told(given, "model", model=True, confidence=0.7, job=job, asked=True)),
        F.when(is_job & (F.col("kind") == "leaf") & image & value.rlike(IMAGES), _told(value, "dependency", "docker", job=own)),
        F.when(script.isNotNull(), _told(own, kind(script), job=own)),
    ]
    several = [
        F.when(field("run") & value.rlike(STEPS), F.transform(called, lambda c: _told(c, kind(value), job=job))),
        F.when(step, F.transform(named, lambda m: _told(m, "model", model=True, confidence=0.5, job=job))),
    ]
    found = rows.select("root", "path", F.inline(F.flatten(F.array_compact(F.array(F.array_compact(F.array(*one)), *several)))))
    found = found.withColumn("model", F.when(F.col("asked"), F.col("model_name")))
    told = lookup(found if models is None else stored(found), models).where("not asked or source is not null")
    return told.select("root", "path", *_OUT[:-1])


@scanner("pipelines")
def pipeline_components(files: DataFrame) -> DataFrame:
    return components(files).withColumn("scanner", F.lit("pipelines")).select(*COLUMNS)
