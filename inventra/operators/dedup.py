"""Deduplication and consolidation: the best row of a group under a declared
total order.  ``max_by`` over a rank struct combines before the shuffle, so a hot
key sends one row per task."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inventra.functions.text import is_test_path, key_of, vector_store_technology
from inventra.operators.joins import agent_sites
from inventra.schema import CONTEXT_FREE_TYPES, full


def consolidation_key(name: Column, model_name: Column | None = None) -> Column:
    return key_of(name if model_name is None else F.coalesce(full(model_name), name))


def best(df: DataFrame, keys: list[str], order: Column, carry: list[str], **more: Column) -> DataFrame:
    """One row per key: ``carry`` of the row with the greatest ``order``."""
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*carry), order).alias("_best"), *(c.alias(n) for n, c in more.items()))
    return out.select(*keys, "_best.*", *more)


#: What tells consolidated rows apart: the key, the type, for agents made at
#: several sites the site, for tools known from an import the file.
ASSET = ["key", "component_type", "site_file", "site_line", "tool_file"]


def keyed(c: DataFrame) -> DataFrame:
    """Components with what they consolidate by (``ASSET``), and ``test``."""
    own = c.withColumn("key", consolidation_key(F.col("name"), F.col("model_name"))).withColumn("test", is_test_path(F.col("file_path")))
    return agent_sites(own).withColumn("tool_file", F.when((F.col("component_type") == "tool") & F.col("anchored"), F.col("file_path")))


def consolidate(c: DataFrame) -> DataFrame:
    """One row per asset, that of its best site: the surest, then one with an
    instantiation marker, then one outside tests, then of an agent in the file
    that makes most of it, then the earliest.  A group is cut to one row per file
    before it meets, so a hot name sends a row per file and task."""
    own = keyed(c)
    carry = ["name", "model_name", "file_path", "line_number", "confidence", "framework", "ord"]
    sure = [F.col("confidence"), F.col("marked").cast("int")]
    early = [-F.col("line_number"), -F.col("ord")]
    files = own.groupBy(*ASSET, "file_path").agg(
        F.max_by(F.struct(*carry), F.struct(*sure, *early)).alias("b"), F.max(F.struct(*(x.alias(f"r{i}") for i, x in enumerate([*sure, *early])))).alias("r"),
        F.count("*").alias("n"), F.bool_and("test").alias("test"), F.bool_or("needs_agentic").alias("needs"))
    rank = F.struct("r.r0", "r.r1", (~F.col("test")).cast("int"), F.when(F.col("component_type") == "agent", F.col("n")).otherwise(0), "r.r2", "r.r3")
    top = files.groupBy(*ASSET).agg(F.max_by("b", rank).alias("b"), F.sum("n").alias("evidence_count"), F.count("*").alias("n_files"), F.bool_and("test").alias("test_only"), F.bool_or("needs").alias("needs_agentic"))
    return top.select(*ASSET, "b.*", "evidence_count", "n_files", "test_only", "needs_agentic")


def evidence(c: DataFrame, assets: DataFrame, services: DataFrame | None = None) -> DataFrame:
    """The sites of each asset but its own: asset (its ord), file, line, service
    (the nearest directory with a manifest, else the file's), test_only."""
    own = keyed(c)
    tied = [own[x].eqNullSafe(assets[x]) for x in ASSET]
    out = own.join(assets.select(*ASSET, F.col("ord").alias("asset")), (own.key == assets.key) & tied[1] & tied[2] & tied[3] & tied[4]).where(own.ord != F.col("asset"))
    out = out.select("asset", own.file_path.alias("file"), own.line_number.alias("line"), own.test.alias("test_only"), own.ord.alias("ord"))
    parent = F.regexp_replace("file", "/?[^/]*$", "")
    if services is None:
        return out.withColumn("service", parent)
    return out.join(services.select(F.col("path").alias("file"), "dir"), "file", "left").withColumn("service", F.coalesce("dir", parent)).drop("dir")


def dedup_context_free(c: DataFrame, types: tuple[str, ...] = CONTEXT_FREE_TYPES) -> DataFrame:
    """Representatives of types that don't hang on their place, with the number
    of rows they stand for: the one that says most (entries of metadata and
    characters of description), the first on ties."""
    own = c.where(F.col("component_type").isin(*types)).withColumn("key", consolidation_key(F.col("name"), F.col("model_name")))
    weight = F.greatest(F.size("metadata"), F.lit(0)) + F.length(F.coalesce("description", F.lit("")))
    return best(own, ["key", "component_type"], F.struct(weight, -F.col("ord")), ["ord"], siblings=F.count("*")).withColumnRenamed("ord", "representative")


def mcp_clients(c: DataFrame) -> DataFrame:
    """One client per file and line: one with an instantiation marker, then one
    named like a wrapper's variable, then the surest, then the first.  Other rows
    all stay."""
    client = F.col("component_type") == "mcp_client"
    wrapper = F.coalesce(F.col("name").endswith("_client"), F.lit(False)).cast("int")
    carry = [x for x in c.columns if x not in ("file_path", "line_number")]
    one = best(c.where(client), ["file_path", "line_number"], F.struct(F.col("marked").cast("int"), wrapper, "confidence", -F.col("ord")), carry)
    return c.where(~client).unionByName(one.select(*c.columns))


def vector_stores(c: DataFrame) -> DataFrame:
    """Rows of one technology, file and line as one store: the surest, then one
    outside tests, then the earliest; with the other places (evidence: structs of
    file and line) that any of them had, and how many rows it stands for.  Rows
    without a technology stay as they are."""
    tech = vector_store_technology(F.col("component_type"), F.col("metadata"), F.col("name"), F.col("model_name"))
    own = c.withColumn("store_technology", tech).withColumn("consolidated_count", F.lit(1).cast("long"))
    keys = ["store_technology", "file_path", "line_number"]
    carry = [x for x in c.columns if x not in (*keys, "evidence", "needs_agentic")]
    order = F.struct(F.col("confidence"), (~is_test_path(F.col("file_path"))).cast("int"), -F.col("ord"))
    places = F.array_distinct(F.flatten(F.collect_list("evidence")))
    one = own.where("store_technology is not null").groupBy(*keys).agg(F.max_by(F.struct(*carry), order).alias("b"), F.count("*").alias("consolidated_count"), F.bool_or("needs_agentic").alias("needs_agentic"), places.alias("evidence"))
    # A store that stands alone keeps what it has.
    other = F.filter("evidence", lambda e: ~((e["file"] == F.col("file_path")) & (e["line"] == F.col("line_number"))))
    one = one.select(*keys, "b.*", "consolidated_count", "needs_agentic", F.array_sort(F.when(F.col("consolidated_count") > 1, other).otherwise(F.col("evidence"))).alias("evidence"))
    rest = own.where("store_technology is null")
    return rest.unionByName(one.select(*rest.columns))


def fan_out(c: DataFrame, representatives: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A representative's verdict for each row it stands for."""
    keyed = c.withColumn("key", consolidation_key(F.col("name"), F.col("model_name")))
    told = representatives.join(verdicts, representatives.representative == verdicts.ord).select("key", "component_type", "verdict")
    return keyed.join(told, ["key", "component_type"], "left")


def first_by(df: DataFrame, keys: list[str], order: Column, carry: list[str]) -> DataFrame:
    out = df.groupBy(*keys).agg(F.min_by(F.struct(*carry), order).alias("_first"))
    return out.select(*keys, "_first.*")


def dedup_edges(r: DataFrame) -> DataFrame:
    """The first edge of each (source, target, type); an end is known by its id,
    else by its name as it stands."""
    side = lambda x: F.when(F.coalesce(f"{x}_instance_id", F.lit("")) != "", F.concat(F.lit("id:"), f"{x}_instance_id")).when(F.coalesce(f"{x}_name", F.lit("")) != "", F.concat(F.lit("name:"), f"{x}_name")).otherwise("")
    own = r.withColumn("_s", side("source")).withColumn("_t", side("target"))
    return first_by(own, ["_s", "_t", "relationship_type"], F.col("ord"), [c for c in r.columns if c != "relationship_type"]).drop("_s", "_t")


def dedup_dependencies(d: DataFrame) -> DataFrame:
    """The first of each name whatever its ecosystem, with the first pin found."""
    return d.groupBy(F.lower("name").alias("key")).agg(
        F.min_by("name", "ord").alias("name"), F.min_by("ecosystem", "ord").alias("ecosystem"),
        F.min_by("pin", F.when(F.col("pin").isNotNull(), F.col("ord"))).alias("pin"), F.min("ord").alias("ord"))


def merge_model_duplicates(c: DataFrame, lines: int = 5) -> DataFrame:
    """Named models of code and configuration each take the first catalogue row
    of their file within ``lines`` that is still free, in order of place: its id,
    its name as wrapper_class, and its framework where they have none.  A file is
    one group; its rows are the models of one source file, others aren't moved."""
    model = F.col("component_type") == "model"
    kb = (F.col("detection_source") == "kb_enrichment") & (F.coalesce("kb_id", F.lit("")) != "")
    named = F.col("detection_source").isin("code_analysis", "config_file") & (F.coalesce("model_name", F.lit("")) != "")
    taking = model & (kb | named)
    own = c.withColumn("wrapper_class", F.lit(None).cast("string"))

    def merge(pdf):
        pdf = pdf.sort_values("ord", kind="stable").reset_index(drop=True)
        given = (pdf["detection_source"] == "kb_enrichment").to_numpy()
        held = pdf["line_number"].tolist()
        # Free rows by line, each line's in order of place, so a row looks at the lines near it alone.
        free: dict[int, deque[int]] = {}
        for j in given.nonzero()[0].tolist():
            free.setdefault(held[j], deque()).append(j)
        took, gone = [], []
        for i in (~given).nonzero()[0].tolist():
            near = min((q[0] for at in range(held[i] - lines, held[i] + lines + 1) if (q := free.get(at))), default=None) if held[i] == held[i] else None
            if near is not None:
                free[held[near]].popleft()
                took.append(i)
                gone.append(near)
        for to, of in (("kb_id", "kb_id"), ("wrapper_class", "name")):
            pdf[to] = pdf[to].astype(object)
            pdf.loc[took, to] = pdf[of].to_numpy(dtype=object)[gone]
        names = pdf["framework"].to_numpy(dtype=object)
        pdf.loc[took, "framework"] = [names[j] if names[i] in ("", "unknown") and names[j] else names[i] for i, j in zip(took, gone, strict=True)]
        return pdf.drop(index=gone)

    # Short rows take long here, so their files are dealt into a stated number of parts.
    dealt = own.where(taking).repartition(int(c.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file_path")
    return own.where(~F.coalesce(taking, F.lit(False))).unionByName(dealt.groupBy("file_path").applyInPandas(merge, own.schema))


def numbered_sources(df: DataFrame, name: str, order: str) -> DataFrame:
    """Repeated names get #2, #3 and so on."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return df.withColumn("label", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("#"), n.cast("string"))))
