"""Edges from what code says: arguments of an agent's construction refer to other
components by variable or by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inventra.operators.joins import suffixes

# Edges of an agent by what its argument's name contains, and what
# the category of the other end contains (and doesn't).
EDGES = (
    ("USES_TOOL", ("tool", "tools", "skills", "abilities"), ("tool",), ()),
    ("USES_LLM", ("llm", "language_model", "chat_model", "model"), ("llm", "model"), ("embedding",)),
    ("USES_MEMORY", ("memory", "checkpointer", "store", "saver", "chat_history"), ("memory",), ()),
    ("USES_RETRIEVER", ("retriever", "retrievers", "search", "search_kwargs"), ("retriever",), ()),
    ("USES_EMBEDDING", ("embedding", "embeddings", "embedding_function", "embed", "embed_model"), ("embedding",), ()),
    ("USES_AGENT", ("agent", "agents", "sub_agents", "subagents", "handoffs", "delegates"), ("agent",), ()),
    ("USES_SKILL", ("skill", "skills", "plugins", "abilities"), ("skill",), ()),
)
# Arguments by which an agent counts as wired; categories that stand in for them.
WIRES = ("llm", "model", "tools", "memory", "retriever", "embedding")


def _holds(c: Column, parts: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(c).rlike("|".join(parts)), F.lit(False)) if parts else F.lit(False)


def references(sources: DataFrame, label: str, hints: tuple[str, ...]) -> DataFrame:
    """source, file_path, label, reference: variables and attributes in arguments
    whose name contains a hint."""
    said = sources.select("instance_id", "file_path", F.explode("arguments").alias("key", "value")).where(_holds(F.col("key"), hints))
    found = F.regexp_extract_all("value", F.lit(r"(?:VARIABLE|ATTRIBUTE):([\w.]+)"), F.lit(1))
    return said.select(F.col("instance_id").alias("source"), "file_path", F.lit(label).alias("label"), F.explode(found).alias("reference")).distinct()


def resolved(refs: DataFrame, c: DataFrame) -> DataFrame:
    """The component that a reference means: the last one that the variable of its
    name, or of its last segment, holds in the file; else the only one of that
    name anywhere.  References to none go."""
    by_var = c.where("coalesce(assigned_target, '') <> ''").groupBy("file_path", F.col("assigned_target").alias("name")).agg(F.max_by("instance_id", "ord").alias("by_var"))
    by_name = c.where("coalesce(name, '') <> ''").groupBy("name").agg(F.count("*").alias("_n"), F.min("instance_id").alias("by_name")).where("_n = 1").drop("_n")
    last = F.element_at(F.split("reference", r"\."), -1)
    asked = refs.select("source", "file_path", "label", "reference", F.posexplode(F.array_distinct(F.array("reference", last))).alias("rank", "name"))
    met = asked.join(by_var, ["file_path", "name"], "left").join(by_name, "name", "left")
    first = met.groupBy("source", "label", "reference").agg(F.min_by("by_var", F.when(F.col("by_var").isNotNull(), F.col("rank"))).alias("v"), F.min_by("by_name", F.when(F.col("by_name").isNotNull(), F.col("rank"))).alias("n"))
    return first.select("source", "label", F.coalesce("v", "n").alias("target")).where("target is not null").distinct()


def derived_edges(c: DataFrame, custom: list[tuple[str, list[str], list[str], list[str]]] = ()) -> DataFrame:
    """source_instance_id, target_instance_id, label, names and categories of the
    edges that arguments say: of agents by ``EDGES``, of datastores their
    embeddings, and custom ones (label, source categories, target categories or
    none, hints), which compare whole categories.  ``c`` has instance_id, name,
    category, file_path, assigned_target, arguments (a map) and ord."""
    agents, stores = c.where(_holds(F.col("category"), ("agent",))), c.where(_holds(F.col("category"), ("datastore",)))
    refs = None
    for label, hints, _, _ in EDGES:
        own = references(agents, label, hints)
        refs = own if refs is None else refs.unionByName(own)
    refs = refs.unionByName(references(stores, "USES_EMBEDDING", next(h for n, h, _, _ in EDGES if n == "USES_EMBEDDING")))
    for label, sources, _, hints in custom:
        if hints:
            refs = refs.unionByName(references(c.where(F.lower("category").isin(*sources)), label, tuple(hints)))
    end = lambda side: c.select(F.col("instance_id").alias(side), F.col("name").alias(f"{side}_name"), F.col("category").alias(f"{side}_category"))
    out = resolved(refs, c).join(end("target"), "target").join(end("source"), "source")
    fits = F.lit(False)
    for label, _, wanted, not_ in EDGES:
        own = _holds(F.col("target_category"), wanted) & ~_holds(F.col("target_category"), not_)
        fits = fits | ((F.col("label") == label) & own & (F.lit(label != "USES_AGENT") | (F.col("source") != F.col("target"))))
    for label, _, targets, _ in custom:
        fits = fits | ((F.col("label") == label) & (F.lower("target_category").isin(*targets) if targets else F.lit(True)))
    return out.where(fits).select(F.col("source").alias("source_instance_id"), F.col("target").alias("target_instance_id"), "label", "source_name", "target_name", "source_category", "target_category").distinct()


#: Parts that a file's agents are dealt into where they are wired by their file.
_PARTS = 8


def _wide(df: DataFrame) -> int:
    """Partitions of a shuffle, stated so that few bytes that lead to many aren't put together."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def same_file_arguments(c: DataFrame) -> DataFrame:
    """Agents that a graph wires (``wired``) without saying to what: arguments
    from the components of their file, the first model, memory, retriever and
    embedding and all tools.  Other rows stay as they are."""
    says = F.exists(F.map_keys("arguments"), lambda k: k.isin(*WIRES))
    bare = F.coalesce(_holds(F.col("category"), ("agent",)) & F.col("wired") & ~says & (F.coalesce("file_path", F.lit("")) != ""), F.lit(False))
    kind = (F.when(_holds(F.col("category"), ("agent",)), None).when(_holds(F.col("category"), ("model", "llm")), "llm").when(_holds(F.col("category"), ("tool",)), "tools").when(_holds(F.col("category"), ("memory",)), "memory")
            .when(_holds(F.col("category"), ("retriever",)), "retriever").when(_holds(F.col("category"), ("embedding",)), "embedding"))
    near = c.select("file_path", kind.alias("kind"), F.concat(F.lit("VARIABLE:"), F.coalesce(F.nullif("assigned_target", F.lit("")), "name")).alias("ref"), "ord").where("kind is not null")
    per_file = near.groupBy("file_path", "kind").agg(F.when(F.col("kind") == "tools", F.concat(F.lit("LIST:"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "tools", F.struct("ord", "ref")))), lambda x: x["ref"]), ","))).otherwise(F.min_by("ref", "ord")).alias("value"))
    held = per_file.groupBy("file_path").agg(F.map_from_entries(F.collect_list(F.struct("kind", "value"))).alias("_more"))
    # A file's list is as long as its tools are many, so it goes to its file's agents
    # in each part and is never shuffled once for each of them.
    part = F.pmod(F.xxhash64("instance_id"), F.lit(_PARTS)).cast("int")
    agents = c.where(bare).withColumn("_part", part).repartition(_wide(c), "file_path", "_part")
    told = held.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1)))).repartition(_wide(c), "file_path", "_part")
    out = agents.join(told.hint("merge"), ["file_path", "_part"], "left")
    more = F.when(F.col("_more").isNotNull(), F.map_concat("arguments", "_more")).otherwise(F.col("arguments"))
    return c.where(~bare).unionByName(out.withColumn("arguments", more).select(*c.columns))


def slot(category: Column) -> Column:
    """The argument that a component of a category stands in."""
    out = F.lit("tools")
    for name, parts in (("embedding", ("embedding",)), ("retriever", ("retriever",)), ("memory", ("memory",)), ("llm", ("model", "llm")), ("tools", ("tool",))):
        out = F.when(_holds(category, parts), name).otherwise(out)
    return out


def wired_arguments(nodes: DataFrame, c: DataFrame, imports: DataFrame, calls: DataFrame) -> DataFrame:
    """agent, slot, reference: what a graph's nodes say its agent uses.

    nodes: agent, file_path, ref and kind (ref for a variable, call for a nested
    call's name, inner for a variable given to it).  c: instance_id, category, name,
    assigned_target, file_path, ord.  imports: file_path, key (the name there),
    value (in full).  calls: file_path, func, name, target, ord, of what functions
    call.

    A nested call means the first component of each kind whose dotted name ends
    with it.  A variable means the component that it holds, else, of a function,
    those that the function calls, else the component that an imported name holds
    in the module it comes from, else the first whose name the import ends with."""
    # A component's name, its dotted ends and the variable that holds it are looked up by equality.
    held = c.where("coalesce(assigned_target, '') <> ''").groupBy("file_path", F.col("assigned_target").alias("ref")).agg(F.max_by(F.struct("category", "instance_id"), "ord").alias("c"))
    ends = c.where("coalesce(name, '') <> ''").select("category", "ord", "name", F.explode(suffixes(F.col("name"))).alias("end"))
    first_end = ends.groupBy("end", slot(F.col("category")).alias("slot")).agg(F.min("ord").alias("ord"))
    whole = c.where("coalesce(name, '') <> ''").groupBy(F.col("name").alias("end")).agg(F.min_by("category", "ord").alias("category"), F.min("ord").alias("ord"))

    called = nodes.where("kind = 'call'").join(first_end, F.col("ref") == F.col("end")).where(F.col("slot").isin("tools", "llm", "memory")).select("agent", "slot", F.col("ref").alias("reference"))

    asked = nodes.where("kind in ('ref', 'inner')").select("agent", "file_path", "ref", "kind").distinct().join(held, ["file_path", "ref"], "left")
    direct = asked.where("c is not null and kind = 'ref'").select("agent", slot(F.col("c.category")).alias("slot"), F.col("ref").alias("reference"))
    open_ = asked.where("c is null").drop("c")
    funcs = calls.select("file_path", F.col("func").alias("ref")).distinct().withColumn("is_func", F.lit(True))
    open_ = open_.join(funcs, ["file_path", "ref"], "left").withColumn("scoped", F.coalesce("is_func", F.lit(False)) & (F.col("kind") == "ref")).drop("is_func")
    inner = open_.where("scoped").select("agent", "file_path", F.col("ref").alias("func")).distinct().join(calls, ["file_path", "func"])
    inner = inner.select("agent", "file_path", "func", "ord", "name", "target", F.explode(suffixes(F.col("name"))).alias("end")).join(whole.withColumnRenamed("ord", "c_ord"), "end")
    inner = inner.groupBy("agent", "file_path", "func", "ord", "name", "target").agg(F.min_by("category", "c_ord").alias("category"))
    last = lambda x: F.element_at(F.split(x, r"\."), -1)
    scoped = inner.select("agent", slot(F.col("category")).alias("slot"), F.coalesce(F.nullif(last(F.col("target")), F.lit("")), "name").alias("reference"))

    far = open_.where("not scoped").join(imports.groupBy("file_path", F.col("key").alias("ref")).agg(F.max("value").alias("full")), ["file_path", "ref"]).select("agent", "ref", "full").distinct()
    remote, module = last(F.col("full")), F.regexp_replace("full", r"\.?[^.]*$", "")
    modules = c.select("file_path").distinct().select("file_path", F.explode(suffixes(F.regexp_replace(F.regexp_replace("file_path", r"\.py$", ""), "/", "."))).alias("module"))
    ways = F.array_compact(F.array(last(F.nullif("assigned_target", F.lit(""))), last(F.nullif("name", F.lit("")))))
    own = c.select("file_path", "category", "ord", F.explode(F.array_distinct(ways)).alias("remote"))
    there = far.select("agent", "ref", "full", remote.alias("remote"), module.alias("module")).join(modules.join(own, "file_path"), ["module", "remote"])
    named = far.select("agent", "ref", "full", F.explode(suffixes(F.col("full"))).alias("end")).join(whole, "end")
    both = there.select("agent", "ref", "full", F.lit(0).alias("rank"), "ord", "category").unionByName(named.select("agent", "ref", "full", F.lit(1).alias("rank"), "ord", "category"))
    across = both.groupBy("agent", "ref", "full").agg(F.min_by("category", F.struct("rank", "ord")).alias("category")).select("agent", slot(F.col("category")).alias("slot"), F.col("ref").alias("reference"))
    return called.unionByName(direct).unionByName(scoped).unionByName(across).distinct()
