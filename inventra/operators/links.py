"""Links between repositories: what two or more of them share or call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inventra.functions.text import canonical_git, canonical_url, host_root, stripped
from inventra.operators.joins import first_entry, root_of
from inventra.schema import full


def shared(uses: DataFrame, key: str = "key", repo: str = "repo", order: str = "ord", least: int = 2) -> DataFrame:
    """Keys in at least so many repositories, with each one's first occurrence.
    Occurrences are cut to one per repository before they meet by key."""
    first = uses.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key, repo).agg(F.min(order).alias("_o"))
    return first.groupBy(key).agg(F.count("*").alias("repos"), F.array_sort(F.collect_list(repo)).alias("repo_list"), F.min("_o").alias("first_ord")).where(F.col("repos") >= least)


def env_bindings(env: DataFrame, consumers: DataFrame, roots: DataFrame) -> DataFrame:
    """Variables that are defined and read, in two or more repositories together.
    A definition (name, value, source_path, ord) belongs to the first root that
    holds its file; the value is that of the first definition."""
    value = env.groupBy(F.col("name").alias("var")).agg(F.min_by("value", "ord").alias("resolved_value"))
    place = root_of(env.select(F.col("source_path").alias("path")).distinct(), roots)
    p = env.join(place, env.source_path == place.path).select(F.col("name").alias("var"), F.col("root").alias("repo"), F.lit(1).alias("p"), F.lit(0).alias("c"))
    c = consumers.where("coalesce(var, '') <> ''").select("var", "repo", F.lit(0).alias("p"), F.lit(1).alias("c"))
    each = p.unionByName(c).groupBy("var", "repo").agg(F.max("p").alias("p"), F.max("c").alias("c"))
    sums = each.groupBy("var").agg(F.sum("p").alias("producers"), F.sum("c").alias("consumers"), F.count("*").alias("repos"))
    return sums.where("repos >= 2 and consumers > 0").join(value, "var")


def image_env(env: DataFrame, images: DataFrame) -> DataFrame:
    """Images' variables behind all configured ones; a value is never kept."""
    extra = images.select("name", F.lit("").alias("value"), F.lit("image-env").alias("source_type"), F.col("image").alias("source_path"), F.lit(2**62).cast("long").alias("ord")).distinct()
    return env.unionByName(extra.select(*env.columns))


def scanned_identities(sources: DataFrame) -> DataFrame:
    """The repositories that were scanned: by remote, else by name for sources
    that are a git URL."""
    url = F.coalesce(full(stripped(F.col("repo_url"))), F.when(F.col("kind") == "git-url", full(stripped(F.col("source_name")))))
    return sources.select(canonical_git(url).alias("identity")).where("coalesce(identity, '') <> ''").distinct()


def unscanned_upstreams(images: DataFrame, scanned: DataFrame) -> DataFrame:
    """Images' source repositories that weren't scanned."""
    own = images.withColumn("identity", canonical_git(F.col("source_repo_url"))).where("identity is not null")
    return own.join(scanned.select(canonical_git(F.col("remote")).alias("identity")).distinct(), "identity", "left_anti")


# What shares models, and what shares endpoints.
MODEL_LIKE = ("model", "embedding", "llm_endpoint", "model_endpoint")
ENDPOINTS = ("llm_endpoint", "model_endpoint", "vector_store")
AGENT_EDGES = ("USES_MODEL", "USES_TOOL", "USES_VECTOR_STORE", "USES_KNOWLEDGE_BASE", "USES_EMBEDDING", "USES_LLM_ENDPOINT", "USES_MCP_SERVER")
AGENTS = ("agent", "mcp_client", "mcp_server")


def shared_models(c: DataFrame) -> DataFrame:
    """Model names that two or more repositories use."""
    return shared(c.where(F.col("component_type").isin(*MODEL_LIKE)).withColumn("key", F.col("model_name")))


def shared_endpoints(c: DataFrame) -> DataFrame:
    """Endpoints' URLs, without slashes at the end, in two or more repositories."""
    own = c.where(F.col("component_type").isin(*ENDPOINTS) & F.col("name").rlike("^https?://"))
    return shared(own.withColumn("key", F.regexp_replace("name", "/+$", "")))


def propagate_endpoints(c: DataFrame, links: DataFrame) -> DataFrame:
    """An endpoint or store without model name takes the value of its variable's
    link as its URL, surer than before, and as its name unless that is a URL."""
    value = links.where("coalesce(value, '') <> ''").groupBy("var").agg(F.min_by("value", "ord").alias("_v"))
    out = c.join(value, "var", "left")
    hit = F.col("_v").isNotNull() & (F.coalesce("model_name", F.lit("")) == "") & F.col("component_type").isin(*ENDPOINTS)
    new = {"name": F.when(hit & ~F.col("name").startswith("http"), F.col("_v")).otherwise(F.col("name")), "model_name": F.when(~hit, F.col("model_name")), "heuristic_confidence": F.when(hit, F.greatest("heuristic_confidence", F.lit(0.7))).otherwise(F.col("heuristic_confidence"))}
    return out.select(*(new[x].alias(x) if x in new else F.col(x) for x in c.columns), F.when(hit, F.col("_v")).alias("endpoint_url"))


def agent_calls(proxies: DataFrame, cards: DataFrame, other_repo: bool = True) -> DataFrame:
    """Remote agents' proxies (id, repo, remote_url) with the card they call.  A
    card is found under its endpoints and their hosts: under the proxy's URL, and
    only if no card at all is there, under its host.  Of several the first counts
    that is in another repository (or, where asked for, in the same)."""
    e = cards.select(F.col("ord").alias("card_ord"), F.col("repo").alias("card_repo"), F.col("name").alias("card"), F.explode("endpoints").alias("_e"))
    keys = e.select("card_ord", "card_repo", "card", F.explode(F.array_distinct(F.array_compact(F.array(canonical_url(F.col("_e")), host_root(F.col("_e")))))).alias("key"))
    keys = keys.groupBy("key", "card_repo").agg(F.min_by(F.struct("card", "card_ord"), "card_ord").alias("c"))
    asks = proxies.select("id", "repo", F.explode(F.array(F.struct(F.lit(1).alias("tier"), canonical_url(F.col("remote_url")).alias("key")), F.struct(F.lit(2).alias("tier"), host_root(F.col("remote_url")).alias("key")))).alias("_k")).select("id", "repo", "_k.*")
    fits = F.col("card_repo") != F.col("repo") if other_repo else F.col("card_repo") == F.col("repo")
    met = asks.join(keys, "key").groupBy("id", "tier").agg(F.min_by(F.struct("c.card", "card_repo", F.col("tier").alias("tier")), F.when(fits, F.col("c.card_ord"))).alias("c"), F.max(fits).alias("any"))
    first = met.groupBy("id").agg(F.min_by(F.struct("c", "any"), "tier").alias("f")).where("f.any")
    return proxies.join(first.select("id", "f.c.*"), "id").withColumn("relationship_type", F.lit("INVOKES"))


def verified_proxies(c: DataFrame, calls: DataFrame) -> DataFrame:
    """Proxies whose card was found are sure, 0.9 at least."""
    found = calls.select("id", F.lit(True).alias("_ok")).distinct()
    out = c.join(found, "id", "left")
    ok = F.col("_ok").isNotNull()
    new = {"status": F.when(ok, "verified_cross_repo_card").otherwise(F.col("status")), "confidence": F.when(ok, F.greatest("confidence", F.lit(0.9))).otherwise(F.col("confidence"))}
    return out.select(*(new[x].alias(x) if x in new else F.col(x) for x in c.columns))


def agent_models(shared_models: DataFrame, edges: DataFrame) -> DataFrame:
    """Agents' uses of a shared model that another repository has as well."""
    s = shared_models.select(F.col("key").alias("model_name"), F.explode("repo_list").alias("model_repo"))
    own = edges.where(F.col("relationship_type").isin(*AGENT_EDGES) & F.col("source_type").isin(*AGENTS))
    return own.join(s, own.target_name == s.model_name).where("agent_repo <> model_repo").select("source_name", "agent_repo", "relationship_type", "model_name", "model_repo")


def named_roots(occurrences: DataFrame, roots: DataFrame) -> DataFrame:
    """Occurrences whose repository is ``:name:`` with the root of that name."""
    r = roots.groupBy(F.regexp_extract("root", "([^/]*)/*$", 1).alias("_n")).agg(F.max_by("root", "ord").alias("_root"))
    short = F.when(F.col("repo").startswith(":"), F.regexp_replace("repo", "^:+|:+$", ""))
    out = occurrences.withColumn("_n", short).join(r, "_n", "left")
    return out.select(*(F.coalesce("_root", "repo").alias("repo") if x == "repo" else F.col(x) for x in occurrences.columns))


def across_repos(links: DataFrame, occurrences: Column) -> DataFrame:
    """Links with two or more different repositories."""
    return links.where(F.size(F.array_distinct(F.filter(occurrences, lambda o: F.coalesce(o, F.lit("")) != ""))) >= 2)


def quality_bar(links: DataFrame, occurrences: Column) -> DataFrame:
    """Links of which some occurrence has a repository."""
    return links.where(F.exists(occurrences, lambda o: F.coalesce(o, F.lit("")) != ""))


def undefined_refs(refs: DataFrame, env: DataFrame) -> DataFrame:
    """Variables that code reads and nothing defines."""
    return refs.join(first_entry(env).select(F.col("name").alias("var")), "var", "left_anti")
