"""Lookups between components, relationships, catalogue and configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inventra.functions.text import class_segment, framework_family, frameworks_related, is_test_path, key_of, stripped
from inventra.operators.spans import first_around
from inventra.schema import MODEL_TYPES, full


def suffixes(dotted: Column) -> Column:
    """Every dotted suffix of an id, the longest first."""
    parts = F.split(dotted, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts))))


def last_segment(dotted: Column) -> Column:
    return F.element_at(F.split(dotted, r"\."), -1)


def catalogue_lookup(k: DataFrame, symbols: DataFrame, excludes: list[str] = (), custom: DataFrame | None = None) -> DataFrame:
    """Catalogue rows with a symbol's exact id or last segment; parameters left
    out.  Custom rows come in under new ids only: by last segment for a bare
    symbol, by a whole dotted end for a dotted one.  Excluded ids (equal or
    ending so) go last."""
    own = k.where(F.coalesce("label", F.lit("")) != "parameter").withColumn("_seg", last_segment(F.col("id")))
    s = symbols.select(F.col("symbol").alias("_symbol")).distinct()
    exact = own.join(s.where(F.col("_symbol").contains(".")), own.id == F.col("_symbol"), "left_semi")
    found = exact.unionByName(own.join(s.select(last_segment(F.col("_symbol")).alias("_seg")).distinct(), "_seg", "left_semi").select(*exact.columns)).drop("_seg").dropDuplicates(["id"])
    if custom is not None:
        ends = custom.withColumn("_symbol", F.explode(suffixes(F.col("id"))))
        hit = ends.join(s, "_symbol", "left_semi").where(F.col("_symbol").contains(".") | (F.col("_symbol") == last_segment(F.col("id"))) | (F.col("_symbol") == F.col("id"))).select(*custom.columns).dropDuplicates(["id"])
        found = found.unionByName(hit.join(found, "id", "left_anti").select(*found.columns))
    return without_excluded(found, excludes)


def without_excluded(k: DataFrame, excludes: list[str]) -> DataFrame:
    for e in excludes:
        k = k.where(~((F.col("id") == e) | F.col("id").endswith(e)))
    return k


def merged_catalogue(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing rows win over new ones of the same id, and of new ones the first by ``ord``."""
    carry = [c for c in existing.columns if c != "id"]
    first = new.groupBy("id").agg(F.min_by(F.struct(*carry), "ord").alias("_f")).select("id", "_f.*")
    return existing.unionByName(first.join(existing.select("id"), "id", "left_anti").select(*existing.columns))


def ids_by_path(k: DataFrame, segment: str, concepts: list[str]) -> DataFrame:
    """Ids with a segment in their path, where % and _ stand for anything and any
    one character, and one of the concepts in any case; parameters left out."""
    return k.where(F.col("id").like(f"%{segment}%") & F.lower("concept").isin(*(c.lower() for c in concepts)) & (F.coalesce("label", F.lit("")) != "parameter")).select("id").distinct()


def probes(obs: DataFrame) -> DataFrame:
    """What the catalogue is asked for: symbols, of dotted ones the last segment
    and the class as well."""
    dotted = F.col("symbol").contains(".")
    return obs.select(F.explode(F.array_compact(F.array(F.col("symbol"), F.when(dotted, last_segment(F.col("symbol"))), class_segment(F.col("symbol"))))).alias("symbol")).distinct()


# Concepts by the type they make; concepts without one are "other".
CONCEPTS = {
    "agent": "agent", "model": "model", "tool": "tool", "datastore": "vector_store", "vector_store": "vector_store", "embedding": "embedding", "prompt": "prompt",
    "memory": "memory", "retriever": "retriever", "knowledge_base": "knowledge_base", "feature_store": "feature_store", "guardrail": "guardrail", "mcp_server": "mcp_server",
    "mcp_client": "mcp_client", "skill": "skill", "observability": "observability", "dataset": "dataset", "training_run": "training_run", "model_artifact": "model_artifact",
    "reranker": "other", "evaluator": "other", "framework_core": "other",
}
# Parts of an id that tell its type, the first counts; none means no asset.
ID_PARTS = (
    (".chains.", None), (".document_loaders.", None), (".text_splitter.", None), (".text_splitters.", None), (".retrievers.", "retriever"), (".memory.", "memory"),
    (".vectorstores.", "vector_store"), (".embeddings.", "embedding"), (".agents.", "agent"), (".tools.", "tool"), (".prompts.", "prompt"),
)
NO_ASSETS = (
    "RecursiveCharacterTextSplitter", "CharacterTextSplitter", "TokenTextSplitter", "TextSplitter", "SentenceTransformersTokenTextSplitter", "SpacyTextSplitter", "NLTKTextSplitter",
    "TextLoader", "DirectoryLoader", "WebBaseLoader", "PyPDFLoader", "CSVLoader", "UnstructuredFileLoader", "LLMChain", "RetrievalQA", "ConversationalRetrievalChain",
    "SequentialChain", "SimpleSequentialChain", "ConversationChain",
)


def concept_type(concept: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, kind in CONCEPTS.items():
        out = F.when(concept == name, kind).otherwise(out)
    return out


def refined_type(id_: Column, kind: Column) -> Column:
    """A concept's type corrected by the id's path; null for what is no asset."""
    out = kind
    for part, told in reversed(ID_PARTS):
        stays = F.when(kind.isin("mcp_client", "mcp_server"), kind).otherwise(told) if told else F.lit(None).cast("string")
        out = F.when(id_.contains(part), stays).otherwise(out)
    return F.when(~last_segment(id_).isin(*NO_ASSETS), out)


def match_catalogue(obs: DataFrame, k: DataFrame) -> DataFrame:
    """Each observation (obs_id, symbol, imported: frameworks that its file
    imports) with its catalogue row: tier 1 exact id, 2 a dotted end of the id, 3
    its class; 9 is partial: the row's framework isn't the observation's, and id
    says which it would have been.  Of several rows that counts whose framework
    begins with the observation's module, then an imported one, then one whose
    path agrees with its concept; the least id on ties.  A bare lower-case symbol
    is a variable and only matches exactly.

    The index holds one row per end and framework, so a common class name meets
    as many rows as there are frameworks that have it."""
    kind = concept_type(F.col("concept"))
    refined = refined_type(F.col("id"), kind)
    score = F.when(kind.isNull(), 0).when(refined.isNull(), 2).when(refined != kind, 1).otherwise(0)
    index = k.select("id", F.coalesce("framework", F.lit("")).alias("k_framework"), score.alias("score"), F.explode(suffixes(F.col("id"))).alias("end"))
    index = index.groupBy("end", "k_framework").agg(F.min("id").alias("first"), F.min(F.struct("score", "id")).alias("agreeing"))
    own = obs.withColumn("module", F.when(F.col("symbol").contains("."), F.split_part("symbol", F.lit("."), F.lit(1))).otherwise(""))
    exact = own.join(k.select(F.col("id").alias("symbol")).distinct(), "symbol").select("obs_id", F.lit(1).alias("tier"), F.col("symbol").alias("id"))
    rest = own.join(exact.select("obs_id"), "obs_id", "left_anti").where(F.col("symbol").contains(".") | ~F.col("symbol").rlike(r"^\p{Ll}"))
    asks = rest.select("obs_id", "module", "imported", F.explode(F.array(F.struct(F.lit(2).alias("tier"), F.col("symbol").alias("end")), F.struct(F.lit(3).alias("tier"), class_segment(F.col("symbol")).alias("end")))).alias("a")).select("obs_id", "module", "imported", "a.*")
    met = asks.join(index, "end")
    related = frameworks_related(F.col("module"), F.col("k_framework"))
    own_module = (F.col("module") != "") & (F.col("k_framework") != "") & F.col("k_framework").startswith(F.col("module"))
    imported = (F.col("k_framework") != "") & (F.array_contains("imported", F.col("k_framework")) | F.array_contains("imported", framework_family(F.col("k_framework"))))
    made = lambda rank, score, id_: F.struct(F.lit(rank).alias("rank"), score.alias("score"), id_.alias("id"))
    rank = F.when(own_module, made(0, F.lit(0), F.col("first"))).when(imported, made(1, F.lit(0), F.col("first"))).otherwise(made(2, F.col("agreeing.score"), F.col("agreeing.id")))
    best = met.withColumn("related", related).withColumn("r", F.struct(rank.alias("rank"), "related")).groupBy("obs_id", "tier").agg(F.min(F.when(F.col("related"), F.col("r"))).alias("near"), F.min("r").alias("any"))
    # Of ends of the name related rows come first; of a class's the best, related or not.
    sure = F.when(F.col("tier") == 2, F.col("near")).when(F.col("any.related"), F.col("any"))
    found = best.select("obs_id", F.when(sure.isNotNull(), F.col("tier")).otherwise(9).alias("tier"), "tier", F.coalesce(sure, F.col("any")).alias("r")).toDF("obs_id", "tier", "asked", "r")
    top = found.groupBy("obs_id").agg(F.min_by(F.struct("tier", F.col("r.rank.id").alias("id")), "asked").alias("t")).select("obs_id", "t.tier", "t.id")
    return exact.unionByName(top)


def first_entry(env: DataFrame) -> DataFrame:
    """The first definition of each name."""
    return env.groupBy("name").agg(F.min_by(F.struct("value", "source_type", "source_path"), "ord").alias("entry")).select("name", "entry.*")


def resolve(c: DataFrame, env: DataFrame, registry: DataFrame) -> DataFrame:
    """What configuration says of components that name a variable (``env``, else
    ``config_key``): the first definition gives a store its index, an endpoint its
    URL and any other its model, if it has none; placeholders in a model's name
    are filled.  A model that the registry (a column model) knows is confirmed,
    another one needs review.  A model named after its variable is renamed.

    Adds resolved_from, resolved_value; agentic_hint says what is missing."""
    md = F.col("metadata")
    keyed = c.withColumn("_env", F.coalesce(full(md["env"]), full(md["config_key"]))).withColumn("_row", F.struct(*c.columns))
    e = env.groupBy("name").agg(F.min_by(F.struct("value", "source_type"), "ord").alias("_e")).select(F.col("name").alias("_env"), F.col("_e.value").alias("_value"), F.col("_e.source_type").alias("_from"))
    out = keyed.join(e, "_env", "left")
    t, got = F.col("component_type"), F.col("_from").isNotNull()
    value = full(F.col("_value"))
    store, endpoint = t == "vector_store", t.isin("llm_endpoint", "model_endpoint")
    out = out.withColumn("_model", F.when(got & endpoint & value.isNotNull(), value).when(got & ~store & F.col("model_name").isNull(), value).otherwise(F.col("model_name")))
    out = substitute(out, "_model", env)
    open_ = F.col("_model").rlike(r"\$\{[^}]+\}")
    asked = got & ~F.coalesce(F.col("_model") == "", F.lit(True)) & ~F.coalesce(open_, F.lit(False))
    r = registry.select(stripped(F.lower("model")).alias("_known")).distinct().withColumn("_hit", F.lit(True))
    out = out.join(r, stripped(F.lower("_model")) == F.col("_known"), "left")
    hit = F.coalesce("_hit", F.lit(False))
    conf = F.when(got & (store | (endpoint & value.isNotNull())), F.greatest("heuristic_confidence", F.lit(0.8))).otherwise(F.col("heuristic_confidence"))
    conf = F.when(asked & hit, F.greatest(conf, F.lit(0.85))).when(asked, F.greatest(conf, F.lit(0.5))).otherwise(conf)
    missing = ~got & F.col("_env").isNotNull() & F.col("needs_agentic")
    needs = F.when(asked, ~hit).when(got & store, F.lit(False)).otherwise(F.col("needs_agentic"))
    hint = F.when(asked & hit, "").when(asked, "not_in_registry").when(missing, "undefined_variable").otherwise(F.col("agentic_hint"))
    rename = F.col("name").startswith("env:") & t.isin("model", "embedding") & (F.coalesce("_model", F.lit("")) != "") & ~F.lower("_model").rlike("^https?://") & ~open_
    new = {"name": F.when(F.coalesce(rename, F.lit(False)), F.col("_model")).otherwise(F.col("name")), "model_name": F.col("_model"), "heuristic_confidence": conf, "needs_agentic": needs, "agentic_hint": hint}
    return out.select(*(new[x].alias(x) if x in new else F.col(x) for x in c.columns), F.col("_from").alias("resolved_from"), F.when(got, F.col("_value")).alias("resolved_value"))


def substitute(df: DataFrame, column: str, env: DataFrame) -> DataFrame:
    """``${NAME}`` by the first definition; unknown names stay as they stand.
    Distinct values alone are taken apart, and joined back by value."""
    held = df.where(F.col(column).contains("${")).select(F.col(column).alias("_whole")).distinct()
    pieces = held.select("_whole", F.posexplode(F.split("_whole", r"(?=\$\{)|(?<=\})")).alias("_p", "_t"))
    name = stripped(F.regexp_extract("_t", r"^\$\{([^}]+)\}$", 1))
    told = pieces.withColumn("_n", name).join(first_entry(env).select(F.col("name").alias("_n"), F.col("value").alias("_v")), "_n", "left")
    back = told.groupBy("_whole").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("_p", F.coalesce("_v", "_t").alias("v")))), lambda s: s["v"])).alias("_new"))
    out = df.join(back, df[column] == F.col("_whole"), "left")
    return out.select(*(F.coalesce("_new", c).alias(c) if c == column else F.col(c) for c in df.columns))


def enclosing(points: DataFrame, spans: DataFrame, key: str, at: str, begin: str, end: str, name: str, carry: list[str]) -> DataFrame:
    """The outermost span of the same key around each point that is in one."""
    found = first_around(points, spans, [key], at, begin, end, [F.col(begin), F.col(end), F.col(name)], [name], carry)
    return found.select(*carry, F.col(f"found.{name}").alias("enclosing"))


def nearest_preceding(rows: DataFrame, key: str, at: str, is_site: Column, value: Column) -> DataFrame:
    """The last site before each row of its key, else the key's first."""
    before = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    site = F.when(is_site, value)
    return rows.withColumn("site", F.coalesce(F.last(site, ignorenulls=True).over(before), F.first(site, ignorenulls=True).over(whole)))


def agent_sites(c: DataFrame) -> DataFrame:
    """``c`` (key, component_type, file_path, line_number, created, confidence,
    ord) with the site that each row of an agent stands for, where a key's agents
    are created at more than one: its own, the nearest before it in its file, the
    file's first, else the key's best (surest, outside tests, earliest).  Null
    site_line for all other rows."""
    site = (F.col("component_type") == "agent") & F.col("created")
    own = c.where(site)
    many = own.select("key", "file_path", "line_number").distinct().groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key")
    rank = F.struct(F.col("confidence"), (~is_test_path(F.col("file_path"))).cast("int"), -F.col("line_number"), -F.col("ord"))
    best = own.join(many, "key", "left_semi").groupBy("key").agg(F.max_by(F.struct("file_path", "line_number"), rank).alias("_best"))
    split = c.join(best, "key", "left").withColumn("_split", F.col("_best").isNotNull() & (F.col("component_type") == "agent"))
    place = Window.partitionBy("key", "component_type", "file_path").orderBy("line_number", F.when(site, 0).otherwise(1), "ord")
    line = F.when(site, F.col("line_number"))
    here = F.coalesce(F.last(line, ignorenulls=True).over(place.rowsBetween(Window.unboundedPreceding, 0)), F.first(line, ignorenulls=True).over(place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    out = split.withColumn("_line", here)
    return out.select(*c.columns, F.when(F.col("_split"), F.when(F.col("_line").isNotNull(), F.col("file_path")).otherwise(F.col("_best.file_path"))).alias("site_file"), F.when(F.col("_split"), F.coalesce("_line", "_best.line_number")).alias("site_line"))


def near_lines(left: DataFrame, right: DataFrame, key: str, at: str, most: int) -> DataFrame:
    """Pairs of one key at most ``most`` apart, by buckets of that width."""
    l = left.select(F.col(key).alias("k"), F.col(at).alias("l"), F.explode(F.array(*(F.floor(F.col(at) / most) + d for d in (-1, 0, 1)))).alias("b"))
    r = right.select(F.col(key).alias("k"), F.col(at).alias("r"), F.floor(F.col(at) / most).alias("b"))
    return l.join(r, ["k", "b"]).where(F.abs(F.col("l") - F.col("r")) <= most).select(F.col("k").alias(key), "l", "r")


def root_of(files: DataFrame, roots: DataFrame) -> DataFrame:
    """The first root, in scan order, that is an ancestor of each file."""
    up = files.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.concat_ws("/", F.slice(F.split("path", "/"), 1, i)))).alias("_up"))
    return up.join(roots, up._up == roots.root).groupBy("path").agg(F.min_by("root", "ord").alias("root"))


def backfill_ids(names: DataFrame, lookup: DataFrame) -> DataFrame:
    """The id of a name that exactly one row has, under its name or under its
    model's name; else null."""
    alias = F.array(F.col("name"), F.when(F.col("model_name") != F.col("name"), F.col("model_name"))) if "model_name" in lookup.columns else F.array("name")
    each = lookup.select("id", F.explode(F.filter(alias, lambda x: F.coalesce(x, F.lit("")) != "")).alias("name"))
    single = each.groupBy("name").agg(F.count("*").alias("_n"), F.min("id").alias("id")).where("_n = 1").drop("_n")
    return names.join(single, "name", "left")


def types_by_name(r: DataFrame, c: DataFrame) -> DataFrame:
    """Edges with the type of the last component that has the target's name; a
    model counts under its model's name as well, after its own."""
    rows = c.select("name", "component_type", F.col("ord"), F.lit(0).alias("_second"))
    if "model_name" in c.columns:
        models = c.where(F.col("component_type").isin(*MODEL_TYPES) & (F.coalesce("model_name", F.lit("")) != ""))
        rows = rows.unionByName(models.select(F.col("model_name").alias("name"), "component_type", "ord", F.lit(1).alias("_second")))
    last = rows.groupBy("name").agg(F.max_by("component_type", F.struct("ord", "_second")).alias("target_type"))
    return r.join(last, r.target_name == last.name, "left").drop("name")


def end_key(instance_id: Column, name: Column) -> Column:
    """An edge's end: by id, else by name; null without either."""
    return F.when(F.coalesce(instance_id, F.lit("")) != "", F.concat(F.lit("id:"), instance_id)).when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit("name:"), name))


def propagate_models(c: DataFrame, r: DataFrame) -> DataFrame:
    """A component without model name (null) takes the target of its last edge to
    a model or embedding: the edge that has its id, else one that has its name."""
    uses = r.where(F.col("relationship_type").isin("USES_EMBEDDING", "USES_MODEL")).withColumn("_k", end_key(F.col("source_instance_id"), F.col("source_name")))
    last = uses.where("_k is not null").groupBy("_k").agg(F.max_by("target_name", "ord").alias("_target"))
    by_id, by_name = (last.select(F.col("_k").alias(f"_k{i}"), F.col("_target").alias(f"_t{i}")) for i in (1, 2))
    out = c.join(by_id, F.concat(F.lit("id:"), F.nullif(c.instance_id, F.lit(""))) == F.col("_k1"), "left").join(by_name, F.concat(F.lit("name:"), F.nullif(c.name, F.lit(""))) == F.col("_k2"), "left")
    return out.withColumn("model_name", F.coalesce("model_name", "_t1", "_t2")).select(*c.columns)


def surviving_edges(r: DataFrame, c: DataFrame) -> DataFrame:
    """Edges both of whose ends are still there: by id where there is one, else by
    the name or the model's name of a component, without case and outer space."""
    ids = c.select(F.concat(F.lit("id:"), F.col("instance_id")).alias("_key"))
    names = c.select(F.explode(F.array("name", "model_name")).alias("_n")).where("coalesce(_n, '') <> ''").select(F.concat(F.lit("name:"), key_of(F.col("_n"))).alias("_key"))
    there = ids.unionByName(names).distinct()
    out = r
    for side in ("source", "target"):
        given, name = F.col(f"{side}_instance_id"), F.col(f"{side}_name")
        key = F.when(F.coalesce(given, F.lit("")) != "", F.concat(F.lit("id:"), given)).when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit("name:"), key_of(name)))
        out = out.withColumn("_key", key).join(there, "_key", "left_semi")
    return out.select(*r.columns)


def without_names(c: DataFrame, other: DataFrame) -> DataFrame:
    """Rows whose key isn't among the other's (tools that are vector stores)."""
    named = lambda df: key_of(F.coalesce(full(F.col("model_name")), F.col("name")) if "model_name" in df.columns else F.col("name"))
    own = c.withColumn("_k", named(c))
    return own.join(other.select(named(other).alias("_k")).distinct(), "_k", "left_anti").select(*c.columns)


def without_superseded_imports(c: DataFrame) -> DataFrame:
    """Import lines' candidates go where their file makes an instance of the class."""
    m = F.col("metadata")
    made = F.coalesce(full(m["call_pattern"]), full(m["kb_id"]), full(m["catalog_constructor"]))
    seen = c.where(made.isNotNull() & m["import_statement"].isNull()).select("file_path", last_segment(made).alias("name"), F.lit(True).alias("_made")).distinct()
    out = c.join(seen, ["file_path", "name"], "left")
    return out.where(~((F.coalesce(m["import_statement"], F.lit("")) != "") & F.col("_made").isNotNull())).select(*c.columns)


def cascade_removals(c: DataFrame, removed: DataFrame) -> DataFrame:
    """What a removal takes along: rows of its key, unless all removals of the key
    were weak and the row isn't, or all were of tests and the row isn't, or one is
    bound to its file (``local``) and the row lies in none of such files.
    Protected rows neither go nor take along."""
    files = F.array_distinct(F.collect_list(F.when(F.col("local"), F.col("file_path"))))
    rule = removed.where(~F.col("protected")).groupBy("key").agg(F.bool_and("weak").alias("only_weak"), F.bool_and("test").alias("only_test"), files.alias("files"))
    hit = c.join(rule, "key").where(~F.col("protected") & (~F.col("only_weak") | F.col("weak")) & (~F.col("only_test") | F.col("test")) & ((F.size("files") == 0) | F.array_contains("files", F.col("file_path")))).select("ord")
    return c.join(hit, "ord", "left_anti").select(*c.columns)


def reinstate(kept: DataFrame, protected: DataFrame, key: str, id_: str = "instance_id") -> DataFrame:
    """Protected rows that are gone come back, one for each key of which no
    protected row is left: the first by ``ord``.  Kept rows say whether they
    are ``protected``."""
    gone = protected.join(kept.select(id_), id_, "left_anti").join(kept.where("protected").select(key), key, "left_anti")
    carry = [c for c in kept.columns if c != key]
    first = gone.groupBy(key).agg(F.min_by(F.struct(*carry), "ord").alias("_f")).select(key, "_f.*")
    return kept.unionByName(first.select(*kept.columns))


def repo_pairs(uses: DataFrame) -> DataFrame:
    """Pairs of repositories with what both use, counted: (repo, item) rows
    meet on the item, and pairs are summed before they are shuffled."""
    a, b = uses.distinct().alias("a"), uses.distinct().alias("b")
    both = a.join(b, (F.col("a.item") == F.col("b.item")) & (F.col("a.repo") < F.col("b.repo")))
    return both.groupBy(F.col("a.repo").alias("left_repo"), F.col("b.repo").alias("right_repo")).agg(F.count("*").alias("shared"))


def variable_flows(defined: DataFrame, used: DataFrame) -> DataFrame:
    """From the repository that defines a variable to another one that uses it."""
    d, u = defined.select("var", F.col("repo").alias("source_repo")).distinct(), used.select("var", F.col("repo").alias("target_repo")).distinct()
    return d.join(u, "var").where("source_repo <> target_repo").select("source_repo", "target_repo", "var")


def service_dir(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """The nearest directory above each file that holds a manifest."""
    parts = F.split("path", "/")
    up = files.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(i.alias("depth"), F.concat_ws("/", F.slice(parts, 1, i)).alias("dir")))).alias("u"))
    found = up.join(manifests.select("dir").distinct(), F.col("u.dir") == F.col("dir"))
    return found.groupBy("path").agg(F.max_by("dir", "u.depth").alias("dir"))
