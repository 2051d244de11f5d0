"""Queries of operators on calls, payloads, sets, proxies, services and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from inventra.catalogue import _t, query
from inventra.operators import agentic, compare, graph, joins, links, scope
from inventra.sources import files as S


@query("""with c as (select p_partkey as call_id, 'm' || (p_size % 5) as module, 'C' || (p_size % 3) as class, 'f' || (p_partkey % 7) as last, case p_partkey % 3 when 0 then '' when 1 then 'b.' else 'a.b.' end as head from part),
f as (select distinct case s_suppkey % 4 when 0 then 'm' || (s_suppkey % 5) || '.f' when 1 then 'm' || (s_suppkey % 5) || '.C' || (s_suppkey % 3) || '.f' when 2 then 'b.f' else 'a.b.f' end || (s_suppkey % 7) as q from supplier),
k as (select call_id, unnest([module || '.' || last, module || '.' || class || '.' || last, case head when '' then last else 'b.' || last end, head || last]) as q, unnest([0, 1, 2, 3]) as rank from c)
select call_id, arg_min(q, case when q in (select q from f) then rank else 4 + rank end) as callee from k group by 1""")
def resolved_calls(spark, d):
    k, size, s = F.col("p_partkey"), F.col("p_size"), F.col("s_suppkey")
    text = lambda head, n: F.concat(F.lit(head), n.cast("string"))
    head = F.when(k % 3 == 0, "").when(k % 3 == 1, "b.").otherwise("a.b.")
    calls = _t(spark, d, "part").select(k.alias("call_id"), text("m", size % 5).alias("module"), text("C", size % 3).alias("class"), F.concat(head, text("f", k % 7)).alias("name"))
    name = F.when(s % 4 == 0, F.concat(text("m", s % 5), F.lit(".f"))).when(s % 4 == 1, F.concat(text("m", s % 5), text(".C", s % 3), F.lit(".f"))).when(s % 4 == 2, "b.f").otherwise("a.b.f")
    return graph.resolve_calls(calls, _t(spark, d, "supplier").select(F.concat(name, (s % 7).cast("string")).alias("qualname")).distinct())


@query("""select l_orderkey, l_linenumber from lineitem where l_partkey in (select s_suppkey from supplier) and l_suppkey in (select s_suppkey from supplier)""")
def graph_payload(spark, d):
    edges = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("source_instance_id"), F.col("l_suppkey").alias("target_instance_id"))
    return graph.payload(_t(spark, d, "supplier").select(F.col("s_suppkey").alias("instance_id")), edges).select("l_orderkey", "l_linenumber")


@query("""with p as (select distinct p_brand as b, p_size as s from part), e as (select distinct p_brand, p_size % 40 from part), n as (select (select count(*) from (from p intersect from e)) as tp, (select count(*) from (from p except from e)) as fp, (select count(*) from (from e except from p)) as fn)
select tp, fp, fn, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from n""")
def set_comparison(spark, d):
    p = _t(spark, d, "part").select(F.col("p_brand").alias("b"), F.col("p_size").alias("s"))
    return compare.sets(p, p.withColumn("s", F.col("s") % 40), ["b", "s"])


@query("""select p_partkey as id, case when hit then 'verified_cross_repo_card' else 'open' end as status, case when hit then greatest(c, 0.9) else c end as confidence from (select p_partkey, (p_size % 11) / 10.0::double as c, p_partkey in (select ps from (select l_partkey as ps, max(l_quantity) as q from lineitem group by 1) where q = 50) as hit from part)""")
def verified_proxies(spark, d):
    calls = _t(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("id"))
    c = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("open").alias("status"), ((F.col("p_size") % 11) / 10).alias("confidence"))
    return links.verified_proxies(c, calls)


@query("""with m as (select distinct 'r/s' || (s_suppkey % 40) || case when s_suppkey % 2 = 0 then '/t' || (s_suppkey % 3) else '' end as dir from supplier),
f as (select 'r/s' || p_size || '/t' || (p_partkey % 3) || '/f' || p_partkey || '.py' as path, 'r/s' || p_size as a, 'r/s' || p_size || '/t' || (p_partkey % 3) as b from part)
select path, case when b in (from m) then b else a end as dir from f where a in (from m) or b in (from m)""")
def service_directories(spark, d):
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    text = lambda head, n: F.concat(F.lit(head), n.cast("string"))
    files = _t(spark, d, "part").select(F.concat(text("r/s", F.col("p_size")), text("/t", k % 3), text("/f", k), F.lit(".py")).alias("path"))
    return joins.service_dir(files, _t(spark, d, "supplier").select(F.concat(text("r/s", s % 40), F.when(s % 2 == 0, text("/t", s % 3)).otherwise("")).alias("dir")))


@query("""select p_partkey as id, case when p_size % 3 = 0 then 'added' else 'unreviewed' end as decision, case when p_size % 4 = 0 and p_size % 5 <> 0 then 'prompt without text' when p_size % 3 = 0 then 'added in review' else 'found by a scanner' end as justification, case when p_partkey % 2 = 0 and p_size > 1 then 'source_location' else 'metadata' end as evidence, p_size % 3 <> 0 as needs_agentic from part""")
def annotated_rows(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    c = _t(spark, d, "part").select(k.alias("id"), F.when(size % 3 == 0, "agentic").otherwise("code").alias("detection_source"), F.when(size % 4 == 0, "prompt").otherwise("tool").alias("component_type"), F.when(size % 5 == 0, "t").alias("text"), F.when(k % 2 == 0, "f.py").otherwise("").alias("file_path"), (size - 1).alias("line_number"))
    a = F.col("decision_annotation")
    return agentic.annotate(c).select("id", a["decision"].alias("decision"), a["justification"].alias("justification"), a["evidence_kinds"][0].alias("evidence"), "needs_agentic")


@query("""select p_partkey as id, p_brand in (select 'Brand#' || (c_custkey % 30) from customer) as cached from part""")
def cached_verdicts(spark, d):
    """Parts whose content has a verdict already, and the others."""
    cache = _t(spark, d, "customer").select(F.concat(F.lit("Brand#"), (F.col("c_custkey") % 30).cast("string")).alias("content_key")).distinct()
    hit, rest = agentic.split_cached(_t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("content_key")), cache)
    return hit.select("id", F.lit(True).alias("cached")).unionByName(rest.select("id", F.lit(False).alias("cached")))


@query("""select p_partkey as id, p_partkey % 2 = 0 and p_size % 3 = 0 as protected, p_size % 4 = 0 or p_size % 5 = 0 as marked, p_size % 7 = 0 and p_size % 4 <> 0 as import_only from part""")
def marked_rows(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    note = lambda test, key: F.when(test, F.struct(F.lit(key).alias("k"), F.lit("x").alias("v")))
    notes = F.array_compact(F.array(note(size % 3 == 0, "known_ai_package"), note(size % 4 == 0, "call_pattern"), note(size % 5 == 0, "assigned_to"), note(size % 7 == 0, "import_statement")))
    c = _t(spark, d, "part").select(k.alias("id"), F.when(k % 2 == 0, "dependency").otherwise("model").alias("component_type"), F.map_from_entries(notes).alias("metadata"))
    return c.select("id", scope.is_protected().alias("protected"), scope.has_marker().alias("marked"), scope.is_import_only().alias("import_only"))


@query("""select 'terraform_variable' as kind, 'v' || p_size as name, case when p_partkey % 3 > 0 then p_name end as value, 'r' || (p_partkey % 4) as root, 'f' || p_partkey as path from part where p_size = 7 order by p_partkey % 3 = 0, root, path limit 1""")
def infrastructure_lookup(spark, d):
    """What var.v7 refers to, among definitions of all parts."""
    k, text = F.col("p_partkey"), lambda head, n: F.concat(F.lit(head), n.cast("string"))
    names = _t(spark, d, "part").select(F.lit("terraform_variable").alias("kind"), text("v", F.col("p_size")).alias("name"), F.when(k % 3 > 0, F.col("p_name")).alias("value"), text("r", k % 4).alias("root"), text("f", k).alias("path"), F.lit(0).alias("ord"))
    return S.infrastructure_reference(names, "var.v7", "terraform").drop("ord")
