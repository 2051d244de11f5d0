"""The review stage's contract: which candidates go to a reviewer in which
batches, and how a table of verdicts is applied."""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inventra.functions.text import key_of, short_hash
from inventra.operators.scope import said
from inventra.schema import blank


def is_simple(c: DataFrame) -> Column:
    """Candidates that need no reading: known dependencies, and models with a
    name and no open question."""
    m = F.col("metadata")
    open_question = said("env") | said("env_context") | said("partial_kb_id") | said("suggestive_signal")
    named = F.col("component_type").isin("model", "dependency", "embedding") & ~blank(F.col("model_name")) & ~open_question
    return F.coalesce(((F.col("component_type") == "dependency") & (m["known_ai_package"] == "true")) | named, F.lit(False))


def batches(c: DataFrame, size: int, group: str, order: list[str]) -> DataFrame:
    """Batches of ``size`` in order of directory, running on from one directory
    to the next.  Rows are ranked within their directory alone; what stands
    before a directory is summed over the directories' counts."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    counts = c.groupBy(group).agg(F.count("*").alias("_n"))
    before = counts.select(F.col(group).alias("_g"), F.coalesce(F.sum("_n").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = c.withColumn("_rank", rank).join(before, F.col(group).eqNullSafe(F.col("_g")))
    return out.withColumn("batch", F.floor((F.col("_before") + F.col("_rank")) / size).cast("long")).select(*c.columns, "batch")


# Fixed value: lines on either side of a component's that its verdict hangs on.
AROUND = 15


def code_window(content: Column, line: Column) -> Column:
    """The lines around a component's."""
    lines = F.split(content, "\n")
    begin = F.greatest(line - AROUND, F.lit(1))
    return F.concat_ws("\n", F.slice(lines, begin, F.greatest(line + AROUND - begin + 1, F.lit(0))))


def cache_key(c: DataFrame, files: DataFrame) -> DataFrame:
    """Components with the key of their verdict: place, names, type and the code
    around them."""
    out = c.join(files.select(F.col("path").alias("file_path"), "content"), "file_path", "left")
    text = F.when((F.coalesce("file_path", F.lit("")) != "") & (F.col("line_number") > 0), code_window(F.col("content"), F.col("line_number")))
    parts = [F.coalesce("file_path", F.lit("")), F.col("line_number").cast("string"), F.col("name"), F.col("component_type"), F.coalesce("model_name", F.lit("")), F.nullif(text, F.lit(""))]
    return out.withColumn("content_key", short_hash(F.concat_ws("|", *parts), 24)).select(*c.columns, "content_key")


def content_key(source: Column, settings: Column) -> Column:
    return short_hash(F.concat_ws("\n", source, settings), 24)


def split_cached(c: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a verdict under their content key, and the rest."""
    return c.join(cache, "content_key"), c.join(cache.select("content_key"), "content_key", "left_anti")


def memo(verdicts: DataFrame) -> DataFrame:
    """The last verdict of each (name, type)."""
    return verdicts.groupBy(key_of(F.col("name")).alias("key"), "component_type").agg(F.max_by(F.struct("verdict", "new_type"), "ord").alias("v")).select("key", "component_type", "v.*")


def apply_verdicts(c: DataFrame, verdicts: DataFrame) -> DataFrame:
    """keep, remove and reclassify by instance_id; without a verdict a row stays
    and says that it wasn't reviewed."""
    v = verdicts.groupBy("instance_id").agg(F.max_by(F.struct("verdict", "new_type", "confidence"), "ord").alias("_v"))
    out = c.join(v, "instance_id", "left").where(F.coalesce(F.col("_v.verdict"), F.lit("")) != "remove")
    return out.select(
        *(x for x in c.columns if x not in ("component_type", "agentic_confidence", "needs_agentic", "agentic_hint")),
        F.when(F.col("_v.verdict") == "reclassify", F.col("_v.new_type")).otherwise(F.col("component_type")).alias("component_type"),
        F.coalesce("_v.confidence", "agentic_confidence").alias("agentic_confidence"),
        F.col("_v").isNull().alias("needs_agentic"),
        F.when(F.col("_v").isNull(), "not_reviewed").otherwise(F.col("agentic_hint")).alias("agentic_hint"))


# What evidence of an agent may be.
PATTERNS = ("framework_agent", "react_loop", "framework_inheritance", "a2a_server", "remote_proxy", "other")


def verified_evidence(cited: DataFrame, files: DataFrame, patterns: tuple[str, ...] | None = None) -> DataFrame:
    """``cited`` (path, snippet, start_line, end_line, and pattern where these are
    checked) with status and reason: verified where the snippet stands in the
    cited lines, white space aside; repaired, with the new lines, where it stands
    once elsewhere in the file, over line ends as well; else rejected."""
    shape = "status string, reason string, line int, last_line int"
    own = cited if patterns is None else cited.withColumn("_fits", F.col("pattern").isin(*patterns))
    j = own.join(files.select("path", "content"), "path", "left")

    def judge(content, snippet, start, end, fits):
        if fits is False:
            return "rejected", "pattern", None, None
        words = (snippet or "").split()
        if content is None or not words:
            return "rejected", "no file" if content is None else "no snippet", None, None
        lines = content.splitlines()
        valid = start is not None and end is not None and 1 <= start <= end <= len(lines)
        if valid and " ".join(words) in " ".join(" ".join(lines[start - 1 : end]).split()):
            return "verified", "", start, end
        held, place, text = [], [], ""
        for number, line in enumerate(lines, 1):
            for word in line.split():
                text += (" " if text else "") + word
                held.append(len(text))
                place.append(number)
        want, hits, at = " ".join(words), [], -1
        while (at := text.find(want, at + 1)) >= 0 and len(hits) < 2:
            hits.append(at)
        if len(hits) == 1:
            return "repaired", "", place[bisect_right(held, hits[0])], place[bisect_right(held, hits[0] + len(want) - 1)]
        return "rejected", "ambiguous" if hits else "lines" if not valid else "not found", None, None

    columns = cited.columns

    def run(batches):
        for batch in batches:
            fits = batch["_fits"].to_pylist() if patterns is not None else [None] * batch.num_rows
            rows = [judge(*r) for r in zip(*(batch[c].to_pylist() for c in ("content", "snippet", "start_line", "end_line")), fits, strict=True)]
            keep = [batch[c] for c in columns]
            yield pa.RecordBatch.from_arrays([*keep, *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32())))], names=[*columns, "status", "reason", "line", "last_line"])

    kind = cited.select("*", *(F.lit(None).cast(t.split()[1]).alias(t.split()[0]) for t in shape.split(", "))).schema
    return j.mapInArrow(run, kind)


def annotate(c: DataFrame) -> DataFrame:
    """Decision, justification and evidence kinds of each row."""
    added = F.col("detection_source") == "agentic"
    located = ~blank(F.col("file_path")) & (F.col("line_number") > 0)
    return c.withColumn("decision_annotation", F.struct(F.when(added, "added").otherwise("unreviewed").alias("decision"), F.when((F.col("component_type") == "prompt") & blank(F.col("text")), "prompt without text").when(added, "added in review").otherwise("found by a scanner").alias("justification"), F.when(located, F.array(F.lit("source_location"))).otherwise(F.array(F.lit("metadata"))).alias("evidence_kinds"))).withColumn("needs_agentic", ~added)
