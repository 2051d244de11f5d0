"""Queries of what stays in an inventory, of links, review and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from inventra.catalogue import _INV, _edges, _inventory, _t, query
from inventra.operators import agentic, compare, dedup, extract, joins, links, scope, search
from inventra.plans import assess


def _k():
    return F.col("p_partkey")


def _md(**said):
    """Metadata: what is said under each key, null where nothing is."""
    pairs = [x for key, value in said.items() for x in (F.lit(key), value)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def _parts(spark, d, *columns):
    return _t(spark, d, "part").select("p_partkey", *columns)


@query("""with c as (select p_partkey as k, p_partkey % 2 = 0 as model, p_partkey % 3 = 0 as blank, p_partkey % 5 as m from part)
select k as p_partkey from c where not (model and blank and m in (0, 1, 2)) and not (model and blank and m = 3)""")
def unresolved_models(spark, d):
    m = _k() % 5
    md = _md(partial_kb_id=F.when(m == 0, "x"), kb_id=F.when(m == 1, "y"), detection_method=F.when(m == 2, "bare_provider_client"), env=F.lit("E"))
    c = _parts(spark, d, F.when(_k() % 2 == 0, "model").otherwise("tool").alias("component_type"), F.when(_k() % 3 == 0, "").otherwise("m").alias("model_name"), md.alias("metadata"), F.when(m == 3, "kb_enrichment").alias("detection_source"), F.when(m == 3, "class").alias("kb_label"), F.when(m == 3, "model").alias("kb_concept"))
    return scope.without_unresolved_classes(scope.without_unresolved_candidates(c)).select("p_partkey")


@query("""select p_partkey % 7 = 0 as held, count(*) as n from part group by 1""")
def review_split(spark, d):
    c = _parts(spark, d, F.when(_k() % 7 == 0, "secret").otherwise("tool").alias("component_type"))
    to, held = scope.secrets_apart(c)
    return to.withColumn("held", F.lit(False)).unionByName(held.withColumn("held", F.lit(True))).groupBy("held").agg(F.count("*").alias("n"))


@query("""select p_partkey from part where p_partkey % 3 <> 0 and p_partkey % 5 <> 0 and p_partkey % 4 <> 1""")
def bom_scope(spark, d):
    c = _parts(spark, d, F.when(_k() % 3 == 0, True).when(_k() % 3 == 1, False).alias("test_only"), (_k() % 5 == 0).alias("needs_agentic"), F.when(_k() % 4 == 1, "tests/a.py").when(_k() % 4 == 2, "").otherwise("src/a.py").alias("file_path"))
    return scope.flags_in_scope(scope.strict(scope.in_default_scope(c))).select("p_partkey")


_MODELS = (("OpenAILLM", False), ("gpt-4o", True), ("GPT", False), ("Gpt", True), ("A", True), ("Claude3.5", True), ("Chat/X", True), ("env:LLM", False), ("lower", True))


@query(f"""with c as (select p_partkey as k, {[n for n, _ in _MODELS]}[p_partkey % 9 + 1] as name, {[s for _, s in _MODELS]}[p_partkey % 9 + 1] as stays, ['model', 'embedding', 'tool'][p_partkey % 3 + 1] as t, p_partkey % 4 as m, p_partkey % 11 = 0 as hint from part),
tied as (select distinct {[n for n, _ in _MODELS]}[l_partkey % 9 + 1] as name from lineitem where l_partkey % 9 in (1, 4))
select k as p_partkey from c where hint or not ((t = 'model' and not stays and not (name = 'env:LLM' and m = 1)) or (t = 'embedding' and m in (0, 3) and name not in (from tied)))""")
def post_review_gates(spark, d):
    m = _k() % 4
    name = F.element_at(F.array(*(F.lit(n) for n, _ in _MODELS)), (_k() % 9 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("model", "embedding", "tool"))), (_k() % 3 + 1).cast("int"))
    c = _parts(spark, d, name.alias("name"), kind.alias("component_type"), F.when(m == 1, "own").when(m == 3, "").alias("model_name"), F.when(m == 2, "e").alias("embedding_model"), F.when(_k() % 11 == 0, "failed").otherwise("").alias("agentic_hint"))
    k = F.col("l_partkey") % 9
    r = _t(spark, d, "lineitem").where(k.isin(1, 4)).select(F.element_at(F.array(*(F.lit(n) for n, _ in _MODELS)), (k + 1).cast("int")).alias("source_name"), F.lit("USES_EMBEDDING").alias("relationship_type"))
    return scope.without_unresolved_embedders(scope.without_placeholders(scope.without_class_names(c)), r).select("p_partkey")


@query("""with c as (select p_partkey as k, ['model', 'memory', 'agent', 'agent_proxy'][p_partkey % 4 + 1] as t, p_partkey % 3 = 0 as kb, p_partkey % 5 = 0 as known, p_partkey % 7 = 0 as hint, p_partkey % 6 as e, p_partkey % 10 = 0 as fresh, p_partkey % 8 = 3 as ok from part)
select k as p_partkey from c where fresh or hint or not ((t = 'model' and kb and not known) or (t = 'memory' and kb and e <> 1) or (t in ('agent', 'agent_proxy') and e in (2, 3, 4) and not ok))""")
def evidence_gate(spark, d):
    e, t = _k() % 6, F.element_at(F.array(*map(F.lit, ("model", "memory", "agent", "agent_proxy"))), (_k() % 4 + 1).cast("int"))
    base = lambda md, kind: _parts(spark, d, _k().cast("string").alias("instance_id"), F.concat(F.lit("n"), (_k() % 5).cast("string")).alias("name"), kind.alias("component_type"), F.when(_k() % 3 == 0, "kb_enrichment").otherwise("code_analysis").alias("detection_source"), F.lit("m").alias("model_name"), F.when(_k() % 7 == 0, "failed").otherwise("").alias("agentic_hint"), md.alias("metadata"))
    agent = t.isin("agent", "agent_proxy")
    before = base(_md(import_statement=F.when(e == 2, "import x"), b=F.lit("1")), F.when(agent & (e == 3), "tool").otherwise(t)).where(_k() % 10 != 0)
    after = base(_md(discovery=F.when(e == 4, "structural_react_loop"), import_statement=F.when(e == 2, "import x"), more=F.when(e == 1, "2"), b=F.lit("1")), t)
    # A discovery note changes the metadata, so memories that have one count as enriched: they get none.
    after = after.withColumn("metadata", F.when(t == "memory", F.map_filter("metadata", lambda k, _: k != "discovery")).otherwise(F.col("metadata")))
    known = spark.createDataFrame([("n0",)], "name string")
    verified = _parts(spark, d).where("p_partkey % 8 = 3").select(_k().cast("string").alias("instance_id"))
    return scope.evidence_gate(before, after, known, verified).select("p_partkey")


@query("""select s_suppkey from supplier where s_suppkey % 4 <> 0 and contains(lower(s_name), '5') and s_suppkey % 3 <> 1""")
def repository_filters(spark, d):
    k = F.col("s_suppkey")
    topics = F.when(k % 3 == 0, F.array(F.lit("x"), F.lit("ML"))).when(k % 3 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("ml")))
    r = _t(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("name"), topics.alias("topics"), F.when(k % 4 == 0, True).when(k % 4 == 1, False).alias("is_archived"))
    return scope.repositories(r, "5", "Ml").select("s_suppkey")


@query("""select p_partkey, p_partkey % 6 = 0 as ml, p_partkey % 6 = 1 as llm, p_partkey % 6 = 2 as mcp, p_partkey % 6 = 3 as cache, p_partkey % 6 in (0, 1, 2) as any from part""")
def import_families(spark, d):
    k = _k() % 6
    text = F.when(k == 0, "x = 1\n  import torch.nn as nn").when(k == 1, "from google.generativeai import x").when(k == 2, "import fastmcp").when(k == 3, "from redis import R").when(k == 4, "# import torchx\nimport torchx").otherwise("y = 'import os'")
    return _parts(spark, d, *(extract.imports_family(text, f).alias(f) for f in ("ml", "llm", "mcp", "cache")), extract.imports_any(text).alias("any"))


@query("""select s_suppkey, s_suppkey % 4 in (0, 3) as across, s_suppkey % 4 <> 2 as placed from supplier""")
def link_filters(spark, d):
    k = F.col("s_suppkey") % 4
    o = F.when(k == 0, F.array(F.lit("a"), F.lit("b"), F.lit("a"))).when(k == 1, F.array(F.lit("a"), F.lit(""), F.lit("a"))).when(k == 2, F.array(F.lit(""), F.lit(None).cast("string"))).otherwise(F.array(F.lit("a"), F.lit("c")))
    own = _t(spark, d, "supplier").select("s_suppkey", o.alias("o"))
    across, placed = (f(own, F.col("o")).select("s_suppkey").withColumn(n, F.lit(True)) for n, f in (("across", links.across_repos), ("placed", links.quality_bar)))
    return own.join(across, "s_suppkey", "left").join(placed, "s_suppkey", "left").select("s_suppkey", F.coalesce("across", F.lit(False)).alias("across"), F.coalesce("placed", F.lit(False)).alias("placed"))


@query("""select s_suppkey, case when s_suppkey % 5 = 0 then 'roots/r1' when s_suppkey % 5 = 1 then ':r9:' else 'own/r' || (s_suppkey % 5) end as repo from supplier""")
def named_roots(spark, d):
    k = F.col("s_suppkey") % 5
    roots = spark.createDataFrame([("old/r1", 0), ("roots/r1", 1), ("roots/r2", 2)], "root string, ord int")
    o = _t(spark, d, "supplier").select("s_suppkey", F.when(k == 0, ":r1:").when(k == 1, ":r9:").otherwise(F.concat(F.lit("own/r"), k.cast("string"))).alias("repo"))
    return links.named_roots(o, roots)


_SHARE = "select p_partkey as ord, 'r' || (p_partkey % 4) as repo, ['model', 'embedding', 'tool', 'llm_endpoint', 'vector_store'][p_partkey % 5 + 1] as t, case when p_partkey % 3 = 0 then '' else p_type end as m, case when p_partkey % 2 = 0 then 'https://h/' || (p_size % 20) || '//' else 'n' end as name from part"


def _sharing(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("model", "embedding", "tool", "llm_endpoint", "vector_store"))), (_k() % 5 + 1).cast("int"))
    return _t(spark, d, "part").select(_k().alias("ord"), F.concat(F.lit("r"), (_k() % 4).cast("string")).alias("repo"), kind.alias("component_type"), F.when(_k() % 3 == 0, "").otherwise(F.col("p_type")).alias("model_name"), F.when(_k() % 2 == 0, F.concat(F.lit("https://h/"), (F.col("p_size") % 20).cast("string"), F.lit("//"))).otherwise("n").alias("name"))


@query(f"""with c as ({_SHARE}) select m as key, count(distinct repo) as repos, string_agg(distinct repo, ',' order by repo) as repo_list, min(ord) as first_ord from c where t in ('model', 'embedding', 'llm_endpoint') and m <> '' group by 1 having count(distinct repo) >= 2""")
def shared_models(spark, d):
    return links.shared_models(_sharing(spark, d)).withColumn("repo_list", F.concat_ws(",", "repo_list"))


@query(f"""with c as ({_SHARE}) select rtrim(name, '/') as key, count(distinct repo) as repos, min(ord) as first_ord from c where t in ('llm_endpoint', 'vector_store') and starts_with(name, 'http') group by 1 having count(distinct repo) >= 2""")
def shared_endpoints(spark, d):
    return links.shared_endpoints(_sharing(spark, d)).drop("repo_list")


@query(f"""with c as ({_SHARE}), s as (select m, repo from c where t in ('model', 'embedding', 'llm_endpoint') and m <> '' and m in (select m from c where t in ('model', 'embedding', 'llm_endpoint') group by 1 having count(distinct repo) >= 2) group by 1, 2),
e as (select 'a' || p_partkey as source_name, 'r' || (p_size % 4) as agent_repo, case when p_size % 3 = 0 then 'USES_TOOL' when p_size % 3 = 1 then 'USES_MODEL' else 'DEPENDS_ON' end as rt, p_type as tn, p_partkey % 2 = 0 as agent from part)
select source_name, agent_repo, rt as relationship_type, m as model_name, repo as model_repo from e join s on tn = m where rt <> 'DEPENDS_ON' and agent and repo <> agent_repo""")
def agent_model_links(spark, d):
    size = F.col("p_size")
    e = _t(spark, d, "part").select(F.concat(F.lit("a"), _k().cast("string")).alias("source_name"), F.concat(F.lit("r"), (size % 4).cast("string")).alias("agent_repo"), F.when(size % 3 == 0, "USES_TOOL").when(size % 3 == 1, "USES_MODEL").otherwise("DEPENDS_ON").alias("relationship_type"), F.col("p_type").alias("target_name"), F.when(_k() % 2 == 0, "agent").otherwise("tool").alias("source_type"))
    return links.agent_models(links.shared_models(_sharing(spark, d)), e)


@query("""with l as (select 'v' || (s_suppkey % 30) as var, arg_min(case when s_suppkey % 3 = 0 then null else 'https://h/' || s_suppkey end, s_suppkey) filter (s_suppkey % 3 <> 0) as v from supplier group by 1),
c as (select p_partkey, 'v' || (p_partkey % 40) as var, case when p_partkey % 4 = 0 then 'https://own' else 'env:v' end as name, case when p_partkey % 5 = 0 then 'm' end as m, ['llm_endpoint', 'vector_store', 'model'][p_partkey % 3 + 1] as t, (p_partkey % 10) / 10 as conf from part)
select p_partkey, case when hit and not starts_with(name, 'http') then v else name end as name, case when not hit then m end as model_name, case when hit then greatest(conf, 0.7) else conf end as heuristic_confidence, case when hit then v end as endpoint_url from (select c.*, v, coalesce(v is not null and m is null and t <> 'model', false) as hit from c left join l using (var))""")
def endpoint_values(spark, d):
    s = F.col("s_suppkey")
    l = _t(spark, d, "supplier").select(F.concat(F.lit("v"), (s % 30).cast("string")).alias("var"), F.when(s % 3 == 0, "").otherwise(F.concat(F.lit("https://h/"), s.cast("string"))).alias("value"), s.alias("ord"))
    kind = F.element_at(F.array(*map(F.lit, ("llm_endpoint", "vector_store", "model"))), (_k() % 3 + 1).cast("int"))
    c = _parts(spark, d, F.concat(F.lit("v"), (_k() % 40).cast("string")).alias("var"), F.when(_k() % 4 == 0, "https://own").otherwise("env:v").alias("name"), F.when(_k() % 5 == 0, "m").alias("model_name"), kind.alias("component_type"), ((_k() % 10) / 10).alias("heuristic_confidence"))
    return links.propagate_endpoints(c, l).select("p_partkey", "name", "model_name", "heuristic_confidence", "endpoint_url")


@query("""with c as (select p_partkey, 'f' || (p_size % 6) as f, case when p_partkey % 4 = 0 then 'Cls' || (p_partkey % 9) else 'x' end as name, case when p_partkey % 4 = 0 then true end as imp, case when p_partkey % 7 = 0 then 'a.b.Cls' || (p_partkey % 9) when p_partkey % 7 = 1 then 'Cls' || (p_partkey % 9) end as made from part),
seen as (select distinct f, split_part(made, '.', -1) as name from c where made is not null and imp is null) select p_partkey from c where not (imp is not null and (f, name) in (select (f, name) from seen))""")
def superseded_imports(spark, d):
    cls = F.concat(F.lit("Cls"), (_k() % 9).cast("string"))
    md = _md(import_statement=F.when(_k() % 4 == 0, "from x import y"), call_pattern=F.when(_k() % 7 == 0, F.concat(F.lit("a.b."), cls)), kb_id=F.when(_k() % 7 == 1, cls))
    c = _parts(spark, d, F.concat(F.lit("f"), (F.col("p_size") % 6).cast("string")).alias("file_path"), F.when(_k() % 4 == 0, cls).otherwise("x").alias("name"), md.alias("metadata"))
    return joins.without_superseded_imports(c).select("p_partkey")


@query("""with c as (select p_partkey, case when p_partkey % 3 = 0 then 'mcp_client' else 'tool' end as t, 'f' || (p_size % 8) as f, p_size % 5 as line, case when p_partkey % 2 = 0 then 'stdio_client' else 'w' || p_partkey end as name, p_partkey % 6 = 0 as marked, p_retailprice as confidence from part)
select p_partkey from c where t <> 'mcp_client' union all select p_partkey from (select *, row_number() over (partition by f, line order by marked desc, name = 'stdio_client' desc, confidence desc, p_partkey) as rn from c where t = 'mcp_client') where rn = 1""")
def mcp_client_sites(spark, d):
    size = F.col("p_size")
    c = _parts(spark, d, F.when(_k() % 3 == 0, "mcp_client").otherwise("tool").alias("component_type"), F.concat(F.lit("f"), (size % 8).cast("string")).alias("file_path"), (size % 5).alias("line_number"), F.when(_k() % 2 == 0, "stdio_client").otherwise(F.concat(F.lit("w"), _k().cast("string"))).alias("name"), (_k() % 6 == 0).alias("marked"), F.col("p_retailprice").alias("confidence"), _k().alias("ord"))
    return dedup.mcp_clients(c).select("p_partkey")


@query("""with c as (select p_partkey, case when p_partkey % 3 <> 0 then null when p_partkey % 2 = 0 then 'faiss' else 'redis' end as tech, (case when p_partkey % 5 = 0 then 'tests/' else '' end) || 'f' || (p_size % 4) as f, p_size % 6 as line, p_retailprice as conf, p_partkey % 7 = 0 as needs, p_size % 3 as e from part),
r as (select *, row_number() over (partition by tech, f, line order by conf desc, p_partkey) as rn, count(*) over (partition by tech, f, line) as n, bool_or(needs) over (partition by tech, f, line) as any_needs from c where tech is not null),
ev as (select tech, f, line, n, list_sort(list_distinct(list('g' || e || ':' || e))) as places from r group by 1, 2, 3, 4)
select p_partkey, tech as store_technology, n as consolidated_count, any_needs as needs_agentic, array_to_string(places, ',') as evidence from r join ev using (tech, f, line, n) where rn = 1 union all select p_partkey, null, 1, needs, 'g' || e || ':' || e from c where tech is null""")
def vector_store_sites(spark, d):
    size = F.col("p_size")
    e = (size % 3).cast("string")
    c = _parts(spark, d, F.when(_k() % 3 == 0, "vector_store").otherwise("tool").alias("component_type"), F.when(_k() % 2 == 0, "My FAISS").otherwise("redis-x").alias("name"), F.lit("").alias("model_name"), F.create_map(F.lit("x"), F.lit("y")).alias("metadata"), F.concat(F.when(_k() % 5 == 0, "tests/").otherwise(""), F.lit("f"), (size % 4).cast("string")).alias("file_path"), (size % 6).alias("line_number"), F.col("p_retailprice").alias("confidence"), (_k() % 7 == 0).alias("needs_agentic"), _k().alias("ord"), F.array(F.struct(F.concat(F.lit("g"), e).alias("file"), (size % 3).alias("line"))).alias("evidence"))
    out = dedup.vector_stores(c)
    return out.select("p_partkey", "store_technology", "consolidated_count", "needs_agentic", F.concat_ws(",", F.transform("evidence", lambda x: F.concat_ws(":", x["file"], x["line"].cast("string")))).alias("evidence"))


@query("""select s_nationkey % 7 as source_repo, c_nationkey % 5 as target_repo, s_suppkey % 20 as var from supplier join customer on s_suppkey % 20 = c_custkey % 20 where s_nationkey % 7 <> c_nationkey % 5 group by 1, 2, 3""")
def variable_flows(spark, d):
    p = _t(spark, d, "supplier").select((F.col("s_suppkey") % 20).alias("var"), (F.col("s_nationkey") % 7).alias("repo"))
    return joins.variable_flows(p, _t(spark, d, "customer").select((F.col("c_custkey") % 20).alias("var"), (F.col("c_nationkey") % 5).alias("repo")))


@query(_INV + """, e as (select s as a, d as b, k from r union all select d, s, k from r), m as (select a, bool_or(k = 'USES_GUARDRAIL' or coalesce(t, '') = 'guardrail') as g, bool_or(coalesce(t, '') = 'observability') as o from e left join c on c.id = b group by 1)
select t as component_type, count(*) as n, count(*) filter (g) as guarded, count(*) filter (o) as observed from c left join m on a = id where t in ('agent', 'mcp_server', 'tool') group by 1""")
def guard_coverage(spark, d):
    return assess.coverage_by_type(*_inventory(spark, d))


@query("""with a as (select p_brand as e, p_size as n, case p_partkey % 5 when 0 then 0 when 1 then 1 when 2 then 2 when 3 then 3 else 4 end as r from part where p_partkey % 2 = 0), q as (select distinct p_brand as e, p_size as n from part where p_size < 30)
select e as ecosystem, n as name, max(r) as worst, count(*) as advisories, [1, 5, 10, 20, 25][max(r) + 1] as weight from a join q using (e, n) group by 1, 2""")
def vulnerability_rollup(spark, d):
    p = _t(spark, d, "part")
    severity = F.element_at(F.array(*map(F.lit, ("info", "low", "medium", "high", "critical"))), (_k() % 5 + 1).cast("int"))
    adv = p.where("p_partkey % 2 = 0").select(F.col("p_brand").alias("ecosystem"), F.col("p_size").alias("name"), F.lit("1").alias("version"), severity.alias("severity"))
    own = p.where("p_size < 30").select(F.col("p_brand").alias("ecosystem"), F.col("p_size").alias("name"), F.lit("1").alias("version")).distinct()
    return assess.vulnerabilities(own, adv).select("ecosystem", "name", "worst", "advisories", "weight")


@query("""with t as (select p_brand as c, lower(p_name) as n from part where p_partkey % 3 <> 0 group by 1, 2), f as (select p_brand as c, lower(p_name) as n from part where p_partkey % 4 <> 0 group by 1, 2), x as (select count(*) filter (t.n is not null and f.n is not null) as tp, count(*) filter (t.n is null) as fp, count(*) filter (f.n is null) as fn from t full join f on t.c = f.c and t.n = f.n), m as (select *, tp / (tp + fp) as p, tp / (tp + fn) as r from x)
select tp, fp, fn, round(p, 6) as precision, round(r, 6) as recall, round(2 * p * r / (p + r), 6) as f1 from m""")
def detection_overall(spark, d):
    p = _t(spark, d, "part").select(F.col("p_brand").alias("category"), F.col("p_name").alias("name"), "p_partkey")
    return compare.overall(compare.benchmark_names(p.where("p_partkey % 3 <> 0"), p.where("p_partkey % 4 <> 0")))


_ACT = "['keep', 'remove', 'reclassify']"


@query(f"""with e as (select doc_id, {_ACT}[doc_id % 3 + 1] as a, case when doc_id % 3 = 2 then 't' || (doc_id % 2) end as t from labels), p as (select doc_id, {_ACT}[(doc_id + doc_id % 5 // 4) % 3 + 1] as a, 't' || (doc_id % 4 // 2) as t from documents where doc_id % 7 <> 0),
j as (select e.a as e, e.t as et, p.a as p, p.t as pt from e left join p using (doc_id)),
f as (select x.a, count(*) filter (e = x.a and p = x.a) as tp, count(*) filter (p = x.a and e <> x.a) as fp, count(*) filter (e = x.a and p is distinct from x.a) as fn from j, (select distinct e as a from j union select distinct p from j where p is not null) x group by 1),
g as (select avg(round(case when tp = 0 then 0 else 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) end, 6)) as m from f)
select count(*) as cases, count(*) filter (right_) as correct, round(count(*) filter (right_) / count(*), 6) as accuracy, round(count(p) / count(*), 6) as coverage, round(max(m), 6) as macro_f1 from (select *, coalesce(e = p, false) and (e <> 'reclassify' or coalesce(et, '') = '' or coalesce(et = pt, false)) as right_ from j), g""")
def decision_scores(spark, d):
    k = F.col("doc_id")
    act = lambda n: F.element_at(F.array(*map(F.lit, ("keep", "remove", "reclassify"))), (n % 3 + 1).cast("int"))
    e = _t(spark, d, "labels").select("doc_id", act(k).alias("action"), F.when(k % 3 == 2, F.concat(F.lit("t"), (k % 2).cast("string"))).alias("target_type"))
    p = _t(spark, d, "documents").where("doc_id % 7 <> 0").select("doc_id", act(k + F.floor(k % 5 / 4)).alias("action"), F.concat(F.lit("t"), F.floor(k % 4 / 2).cast("string")).alias("target_type"))
    return compare.decisions(e, p, "doc_id")


@query("""select case when p_partkey % 3 = 0 then 'unspecified' else p_brand end as reason, count(*) as n from part where p_partkey % 2 = 0 group by 1""")
def degradation_reasons(spark, d):
    c = _parts(spark, d, (_k() % 2 == 0).alias("needs_agentic"), F.when(_k() % 3 == 0, "").otherwise(F.col("p_brand")).alias("agentic_hint"))
    return scope.degradations(c)


@query("""with l as (select doc_id, string_split(text, chr(10)) as l from documents where text is not null), w as (select doc_id, doc_id % 7 + 1 as line, l from l)
select doc_id, substr(sha256(concat_ws('|', 'd' || doc_id, cast(line as varchar), 'n', 'model', '', nullif(array_to_string(l[greatest(line - 15, 1):line + 15], chr(10)), ''))), 1, 24) as content_key from w""")
def verdict_keys(spark, d):
    docs = _t(spark, d, "documents").where("text is not null")
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    c = docs.select("doc_id", path.alias("file_path"), (F.col("doc_id") % 7 + 1).cast("int").alias("line_number"), F.lit("n").alias("name"), F.lit("model").alias("component_type"), F.lit(None).cast("string").alias("model_name"))
    return agentic.cache_key(c, docs.select(path.alias("path"), F.col("text").alias("content"))).select("doc_id", "content_key")


@query("""select lower(trim(p_name)) as key, p_type as component_type, arg_max(case when p_size % 2 = 0 then 'keep' else 'remove' end, p_partkey) as verdict from part group by 1, 2""")
def verdict_memo(spark, d):
    v = _t(spark, d, "part").select(F.concat(F.lit(" "), F.upper("p_name")).alias("name"), F.col("p_type").alias("component_type"), F.when(F.col("p_size") % 2 == 0, "keep").otherwise("remove").alias("verdict"), F.lit("x").alias("new_type"), _k().alias("ord"))
    return agentic.memo(v).select("key", "component_type", "verdict")


@query("""select p_partkey, case p_partkey % 6 when 0 then 'verified' when 1 then 'repaired' when 2 then 'rejected' when 3 then 'repaired' else 'rejected' end as status, case p_partkey % 6 when 2 then 'ambiguous' when 4 then 'lines' when 5 then 'pattern' else '' end as reason, case p_partkey % 6 when 0 then 2 when 1 then 2 when 3 then 1 end as line, case p_partkey % 6 when 0 then 2 when 1 then 2 when 3 then 2 end as last_line from part""")
def agent_evidence(spark, d):
    k = _k() % 6
    name = F.concat(F.lit("p"), _k().cast("string"))
    files = _t(spark, d, "part").select(name.alias("path"), F.concat(F.lit("def  agent(x):\n  loop "), name, F.lit("\nreturn\nreturn")).alias("content"))
    want = F.when(k <= 1, F.concat(F.lit("loop  "), name)).when(k == 2, "return").when(k == 3, F.concat(F.lit("agent(x): loop "), name)).when(k == 4, "absent").otherwise("loop")
    cited = _parts(spark, d, name.alias("path"), want.alias("snippet"), F.when(k == 0, 2).when(k == 4, 9).otherwise(1).alias("start_line"), F.when(k == 0, 2).when(k == 4, 9).otherwise(1).alias("end_line"), F.when(k == 5, "odd").otherwise("react_loop").alias("pattern"))
    return agentic.verified_evidence(cited, files, agentic.PATTERNS).select("p_partkey", "status", "reason", "line", "last_line")


@query("""with e as (select 'v' || (s_suppkey % 30) as name, s_suppkey as ord, 'x' || s_suppkey as value from supplier), r as (select *, row_number() over (partition by name order by ord) as rn from e)
select name, max(value) filter (rn = 1) as value, coalesce(string_agg(value, ',' order by ord) filter (rn between 2 and 8), '') as alternates from r group by 1""")
def env_alternates(spark, d):
    s = F.col("s_suppkey")
    e = _t(spark, d, "supplier").select(F.concat(F.lit("v"), (s % 30).cast("string")).alias("name"), F.concat(F.lit("x"), s.cast("string")).alias("value"), s.alias("ord"))
    return search.with_alternates(e).select("name", "value", F.concat_ws(",", "alternates").alias("alternates"))


@query("""select 'env' as kind, c_mktsegment as name, count(distinct c_nationkey) as roots, count(*) as n from customer group by 2 having count(distinct c_nationkey) > 1 union all select 'package', p_brand, count(distinct p_size % 2), count(*) from part group by 2 having count(distinct p_size % 2) > 1""")
def names_across_roots(spark, d):
    env = _t(spark, d, "customer").select(F.col("c_mktsegment").alias("name"), F.col("c_nationkey").cast("string").alias("root"))
    return search.across_roots(env, _t(spark, d, "part").select(F.col("p_brand").alias("name"), (F.col("p_size") % 2).cast("string").alias("root")))


@query("""select relationship_type, count(*) as n from (select case l_returnflag when 'R' then 'USES_TOOL' when 'A' then 'USES_MODEL' else 'x' end as relationship_type from lineitem) group by 1""")
def relationship_totals(spark, d):
    flag = F.col("relationship_type")
    r = _edges(spark, d).withColumn("relationship_type", F.when(flag == "R", "USES_TOOL").when(flag == "A", "USES_MODEL").otherwise("x"))
    return compare.totals(r, "relationship_type")


@query("""select distinct unnest(case when contains(s, '.') then [s, split_part(s, '.', -1), 'Cls' || p_size] else [s] end) as symbol from (select p_size, case when p_partkey % 2 = 0 then 'pkg.Cls' || p_size || '.run' else 'f' || p_size end as s from part)""")
def catalogue_probes(spark, d):
    size = F.col("p_size").cast("string")
    return joins.probes(_t(spark, d, "part").select(F.when(_k() % 2 == 0, F.concat(F.lit("pkg.Cls"), size, F.lit(".run"))).otherwise(F.concat(F.lit("f"), size)).alias("symbol")))


@query("""select c_nationkey as source, count(*) as assets, string_agg(distinct c_mktsegment, ',' order by c_mktsegment) as kinds, max(case when c_nationkey % 2 = 0 then 'host/' || c_nationkey else 'docker.io/library/n' || c_nationkey end) as source_ref_canonical from customer group by 1""")
def report_payloads(spark, d):
    n = F.col("c_nationkey").cast("string")
    c = _t(spark, d, "customer").select(F.col("c_nationkey").alias("source"), F.col("c_mktsegment").alias("component_type"))
    sources = _t(spark, d, "customer").select(F.col("c_nationkey").alias("source"), F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("https://Host/"), n, F.lit(".git"))).otherwise(F.concat(F.lit("n"), n, F.lit(":tag"))).alias("ref"), F.when(F.col("c_nationkey") % 2 == 0, "git").otherwise("container_image").alias("kind")).distinct()
    return search.payloads(c, sources).select("source", "assets", F.concat_ws(",", "kinds").alias("kinds"), "source_ref_canonical")


@query("""select p_brand as ecosystem, p_size as name, max(p_type) as latest, count(*) > 1 as several from part where p_size < 10 group by 1, 2""")
def package_information(spark, d):
    p = _t(spark, d, "part")
    info = p.groupBy(F.col("p_brand").alias("ecosystem"), F.col("p_size").alias("name")).agg(F.max("p_type").alias("latest"), (F.count("*") > 1).alias("several"))
    asked = p.where("p_size < 10").select(F.col("p_brand").alias("ecosystem"), F.col("p_size").alias("name")).distinct()
    return search.package_info(asked, info)


@query("""select (select count(*) from part) = 2000 as rows_match, false as hash_match, count(*) as n_rows from part""")
def catalogue_verification(spark, d):
    p = _t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_name")
    return search.verified(p, 2000, "0" * 64).select("rows_match", "hash_match", "n_rows")
