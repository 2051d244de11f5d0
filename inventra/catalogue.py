"""Every registered query and its DuckDB twin.

The driver's tables stand in for the inventory's relations: parts for
components, lineitems for relationships, suppliers and customers for
repositories, pages for endpoints, events for sites and snapshots.  A query only
projects, applies a library operator, and aliases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inventra.functions import text as X
from inventra.operators import agentic, compare, dedup, graph, joins, links
from inventra.plans import assess

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if oracle:
            _ORACLES[f.__name__] = oracle
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _modules()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _modules()
    return dict(_ORACLES)


_KIND_OF = {"PROMO": "agent", "SMALL": "tool", "LARGE": "model", "MEDIUM": "dependency", "ECONOMY": "embedding"}


def _components(spark: SparkSession, d: str) -> DataFrame:
    """Parts as components: name and brand make the key repeat."""
    p = _t(spark, d, "part")
    word, k = F.element_at(F.split("p_type", " "), 1), F.col("p_partkey")
    kind = F.lit("prompt")
    for given, told in _KIND_OF.items():
        kind = F.when(word == given, told).otherwise(kind)
    return p.select(
        F.concat(F.lit(" "), F.col("p_brand"), F.lit(" ")).alias("name"), F.when(k % 3 == 0, "").when(k % 3 == 1, F.col("p_type")).alias("model_name"), kind.alias("component_type"),
        F.concat(F.when(k % 4 == 0, "tests/").otherwise("src/"), (F.col("p_size") % 9).cast("string"), F.lit(".py")).alias("file_path"),
        F.col("p_size").alias("line_number"), F.col("p_brand").alias("framework"), F.col("p_retailprice").alias("confidence"),
        (k % 5 == 0).alias("marked"), (k % 5 == 0).alias("created"), (k % 6 == 0).alias("anchored"), (k % 7 == 0).alias("needs_agentic"), k.alias("ord"),
        F.when(k % 2 == 0, F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))).otherwise(F.create_map(F.lit("a"), F.lit("1"))).alias("metadata"), F.substring("p_name", 1, 3).alias("description"))


_PARTS = """with c as (select *, lower(trim(coalesce(nullif(model_name, ''), name))) as key from (select ' ' || p_brand || ' ' as name, case when p_partkey % 3 = 0 then '' when p_partkey % 3 = 1 then p_type end as model_name,
 case split_part(p_type, ' ', 1) when 'PROMO' then 'agent' when 'SMALL' then 'tool' when 'LARGE' then 'model' when 'MEDIUM' then 'dependency' when 'ECONOMY' then 'embedding' else 'prompt' end as component_type,
 (case when p_partkey % 4 = 0 then 'tests/' else 'src/' end) || (p_size % 9) || '.py' as file_path, p_size as line_number, p_brand as framework, p_retailprice as confidence, p_partkey % 5 = 0 as marked, p_partkey % 6 = 0 as anchored,
 p_partkey % 4 = 0 as test, p_partkey % 7 = 0 as needs_agentic, p_partkey as ord, 2 - p_partkey % 2 + length(substr(p_name, 1, 3)) as weight from part)) """
_ASSETS = _PARTS + """, site as (select * from c where component_type = 'agent' and marked),
 many as (select key from (select distinct key, file_path, line_number from site) group by 1 having count(*) > 1),
 top as (select key, file_path as bf, line_number as bl from (select *, row_number() over (partition by key order by confidence desc, test, line_number, ord) as rn from site where key in (from many)) where rn = 1),
 near as (select c.*, bf, bl, max(case when component_type = 'agent' and marked then line_number end) over (partition by key, component_type, file_path order by line_number) as before, min(case when component_type = 'agent' and marked then line_number end) over (partition by key, component_type, file_path) as first from c left join top using (key)),
 k as (select *, case when bf is not null and component_type = 'agent' then case when first is null then bf else file_path end end as site_file, case when bf is not null and component_type = 'agent' then coalesce(before, first, bl) end as site_line, case when component_type = 'tool' and anchored then file_path end as tool_file from near),
 f as (select *, count(*) over (partition by key, component_type, site_file, site_line, tool_file, file_path) as per_file from k),
 b as (select *, row_number() over (partition by key, component_type, site_file, site_line, tool_file order by confidence desc, marked desc, test, case when component_type = 'agent' then per_file else 0 end desc, line_number, ord) as rn from f) """


@query(_ASSETS + """, g as (select key, component_type, site_file, site_line, tool_file, count(*) as evidence_count, count(distinct file_path) as n_files, bool_and(test) as test_only, bool_or(needs_agentic) as needs_agentic from f group by 1, 2, 3, 4, 5)
 select b.key, b.component_type, b.site_file, b.site_line, b.tool_file, b.name, b.model_name, b.file_path, b.line_number, b.confidence, b.framework, b.ord, g.evidence_count, g.n_files, g.test_only, g.needs_agentic from b join g on b.key = g.key and b.component_type = g.component_type and b.site_file is not distinct from g.site_file and b.site_line is not distinct from g.site_line and b.tool_file is not distinct from g.tool_file where rn = 1""")
def consolidate_assets(spark, d):
    return dedup.consolidate(_components(spark, d)).withColumn("evidence_count", F.col("evidence_count").cast("long"))


@query(_ASSETS + """select t.ord as asset, o.file_path as file, o.line_number as line, o.test as test_only, o.ord, regexp_replace(o.file_path, '/?[^/]*$', '') as service from b o join b t on t.rn = 1 and o.rn > 1 and o.key = t.key and o.component_type = t.component_type and o.site_file is not distinct from t.site_file and o.site_line is not distinct from t.site_line and o.tool_file is not distinct from t.tool_file""")
def asset_evidence(spark, d):
    c = _components(spark, d)
    return dedup.evidence(c, dedup.consolidate(c))


@query(_PARTS + "select key, component_type, ord as representative, siblings from (select *, count(*) over (partition by key, component_type) as siblings, row_number() over (partition by key, component_type order by weight desc, ord) as rn from c where component_type in ('dependency', 'model', 'model_artifact', 'embedding')) where rn = 1")
def dedup_context_free(spark, d):
    return dedup.dedup_context_free(_components(spark, d)).select("key", "component_type", "representative", "siblings")


@query("select l_orderkey, l_linenumber, l_partkey, l_quantity from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_quantity desc, l_partkey desc, l_suppkey desc) as rn from lineitem) where rn = 1")
def dedup_same_site(spark, d):
    order = F.struct("l_quantity", "l_partkey", "l_suppkey")
    return dedup.best(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], order, ["l_partkey", "l_quantity"])


def _edges(spark, d):
    li = _t(spark, d, "lineitem")
    return li.select(
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey").cast("string")).otherwise("").alias("source_instance_id"), F.lit("").alias("target_instance_id"),
        F.concat(F.lit("S "), F.col("l_suppkey").cast("string")).alias("source_name"), F.concat(F.lit("Part "), (F.col("l_partkey") % 50).cast("string")).alias("target_name"),
        F.col("l_returnflag").alias("relationship_type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))


@query("""with e as (select case when l_linenumber % 2 = 0 then cast(l_suppkey as varchar) else '' end as sid, 'S ' || l_suppkey as source_name, 'Part ' || (l_partkey % 50) as target_name, l_returnflag as relationship_type, l_orderkey * 10 + l_linenumber as ord from lineitem)
select relationship_type, source_name, target_name, ord from (select *, row_number() over (partition by coalesce(nullif(sid, ''), source_name), target_name, relationship_type order by ord) as rn from e) where rn = 1""")
def dedup_edges(spark, d):
    return dedup.dedup_edges(_edges(spark, d)).select("relationship_type", "source_name", "target_name", "ord")


@query("""select lower(p_name) as key, arg_min(p_name, p_partkey) as name, arg_min(p_brand, p_partkey) as ecosystem, arg_min(cast(p_size as varchar), p_partkey) filter (where p_size % 2 = 0) as pin, min(p_partkey) as ord from part group by 1""")
def dedup_dependencies(spark, d):
    p = _t(spark, d, "part")
    rows = p.select(F.col("p_name").alias("name"), F.col("p_brand").alias("ecosystem"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).alias("pin"), F.col("p_partkey").alias("ord"))
    return dedup.dedup_dependencies(rows).select("key", "name", "ecosystem", "pin", "ord")


@query("""with a as (select p_name as name, p_partkey as id from part union all select p_type, p_partkey from part where p_partkey % 50 = 0 and p_type <> p_name), u as (select name, min(id) as id from a group by 1 having count(*) = 1), w as (select distinct name from a) select w.name, u.id from w left join u using (name)""")
def backfill_unique_id(spark, d):
    p = _t(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 50 == 0, F.col("p_type")).alias("model_name"))
    names = p.select("name").union(p.where("model_name is not null").select("model_name")).distinct()
    return joins.backfill_ids(names, p)


_NAMED = "case p_partkey % 3 when 0 then 'model' when 1 then 'llm_endpoint' else 'tool' end"


@query(f"""with a as (select p_brand as name, {_NAMED} as t, p_partkey as ord, 0 as s from part union all select p_type, {_NAMED}, p_partkey, 1 from part where p_partkey % 3 < 2), last as (select name, arg_max(t, ord * 2 + s) as target_type from a group by 1),
e as (select case when l_linenumber % 2 = 0 then p_brand else p_type end as target_name from lineitem join part on l_partkey = p_partkey) select target_type, count(*) as edges from e left join last on target_name = name group by 1""")
def resolve_types_last_wins(spark, d):
    p = _t(spark, d, "part")
    k = F.col("p_partkey") % 3
    c = p.select(F.col("p_brand").alias("name"), F.when(k == 0, "model").when(k == 1, "llm_endpoint").otherwise("tool").alias("component_type"), F.col("p_type").alias("model_name"), F.col("p_partkey").alias("ord"))
    r = _t(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.when(F.col("l_linenumber") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_type")).alias("target_name"))
    return joins.types_by_name(r, c).groupBy("target_type").agg(F.count("*").alias("edges"))


@query("""with r as (select case when l_linenumber % 3 = 0 then 'name:c' || (l_orderkey % 700) else 'id:' || l_orderkey end as k, 'part-' || l_partkey as t, cast(l_linenumber as bigint) * 1000000000 + l_partkey * 1000 + l_suppkey as ord from lineitem where l_returnflag <> 'N'),
last as (select k, arg_max(t, ord) as t from r group by 1) select o_orderkey as id, case when o_orderkey % 4 = 0 then 'own' when o_orderkey % 4 = 1 then '' else coalesce(a.t, b.t) end as model_name from orders left join last a on a.k = 'id:' || o_orderkey left join last b on b.k = 'name:c' || (o_orderkey % 900)""")
def propagate_model(spark, d):
    o, k = _t(spark, d, "orders"), F.col("o_orderkey")
    c = o.select(k.alias("id"), k.cast("string").alias("instance_id"), F.concat(F.lit("c"), (k % 900).cast("string")).alias("name"), F.when(k % 4 == 0, "own").when(k % 4 == 1, "").alias("model_name"))
    named, l = F.col("l_linenumber") % 3 == 0, F.col("l_orderkey")
    r = _t(spark, d, "lineitem").select(F.when(named, "").otherwise(l.cast("string")).alias("source_instance_id"), F.when(named, F.concat(F.lit("c"), (l % 700).cast("string"))).alias("source_name"), F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("target_name"), F.when(F.col("l_returnflag") == "N", "USES_TOOL").when(F.col("l_returnflag") == "A", "USES_MODEL").otherwise("USES_EMBEDDING").alias("relationship_type"), (F.col("l_linenumber") * F.lit(1000000000).cast("long") + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("ord"))
    return joins.propagate_models(c, r).select("id", "model_name")


@query("""with c as (select cast(p_partkey as varchar) as id, lower(trim(p_name)) as n, lower(trim(p_type)) as m from part where p_size < 20), n as (select n from c union select m from c),
e as (select l_orderkey, l_linenumber, case when l_linenumber % 2 = 0 then cast(l_partkey as varchar) end as sid, p_name as sn, case when l_linenumber % 3 = 0 then ' ' || upper(p_type) end as tn from lineitem join part on l_partkey = p_partkey)
select l_orderkey, l_linenumber from e where (case when sid is not null then sid in (select id from c) else lower(trim(sn)) in (from n) end) and tn is not null and lower(trim(tn)) in (from n)""")
def filter_dangling_edges(spark, d):
    p = _t(spark, d, "part")
    c = p.where("p_size < 20").select(F.col("p_partkey").cast("string").alias("instance_id"), F.col("p_name").alias("name"), F.col("p_type").alias("model_name"))
    r = _t(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey").cast("string")).alias("source_instance_id"), F.col("p_name").alias("source_name"), F.lit("").alias("target_instance_id"), F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit(" "), F.upper("p_type"))).alias("target_name"))
    return joins.surviving_edges(r, c).select("l_orderkey", "l_linenumber")


@query("""select p_partkey, p_name as name from part where p_size > 1 and lower(trim(case when p_partkey % 2 = 0 then p_name else p_type end)) not in (select lower(trim(case when p_partkey % 2 = 0 then p_name else p_type end)) from part where p_size = 1)""")
def tool_vs_store(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise(F.col("p_type")).alias("model_name"), "p_size")
    return joins.without_names(p.where("p_size > 1"), p.where("p_size = 1")).select("p_partkey", "name")


@query("""with o as (select o_orderkey as ord, o_custkey as key, o_orderpriority = '5-LOW' as weak, o_orderkey % 2 = 0 as test, o_custkey % 3 = 0 as local, 'f' || (o_orderkey % 5) as f, o_orderpriority = '1-URGENT' as prot, o_orderstatus from orders),
rule as (select key, bool_and(weak) as ow, bool_and(test) as ot, list(f) filter (local) as fs from o where o_orderstatus = 'P' and not prot group by 1)
select ord, key from o where prot or not exists (select 1 from rule r where r.key = o.key and (not ow or o.weak) and (not ot or o.test) and (fs is null or list_contains(fs, o.f)))""")
def removal_cascade(spark, d):
    k = F.col("o_orderkey")
    c = _t(spark, d, "orders").select(k.alias("ord"), F.col("o_custkey").alias("key"), (F.col("o_orderpriority") == "5-LOW").alias("weak"), (k % 2 == 0).alias("test"), (F.col("o_custkey") % 3 == 0).alias("local"), F.concat(F.lit("f"), (k % 5).cast("string")).alias("file_path"), (F.col("o_orderpriority") == "1-URGENT").alias("protected"), "o_orderstatus")
    return joins.cascade_removals(c, c.where("o_orderstatus = 'P'")).select("ord", "key")


@query("""with o as (select o_orderkey as ord, o_custkey as key, o_orderpriority = '1-URGENT' as prot, o_orderstatus = 'O' as kept from orders), k as (select * from o where kept)
select ord, key from k union all select min(ord), key from o where prot and not kept and key not in (select key from k where prot) group by 2""")
def reinstate_protected(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("instance_id"), F.col("o_custkey").alias("key"), (F.col("o_orderpriority") == "1-URGENT").alias("protected"), "o_orderstatus")
    rows = lambda df: df.select("ord", "instance_id", "key", "protected")
    return joins.reinstate(rows(o.where("o_orderstatus = 'O'")), rows(o.where("protected")), "key").select("ord", "key")


@query("""with f as (select l_partkey as key, s_nationkey as repo, min(l_orderkey) as o from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2) select cast(key as varchar) as key, count(*) as repos, min(o) as first_ord, string_agg(cast(repo as varchar), ',' order by repo) as repo_list from f group by 1 having count(*) >= 2""")
def shared_across_sources(spark, d):
    u = _t(spark, d, "lineitem").join(_t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").cast("string").alias("key"), F.col("s_nationkey").alias("repo"), F.col("l_orderkey").alias("ord"))
    return links.shared(u).select("key", "repos", "first_ord", F.concat_ws(",", F.transform("repo_list", lambda r: r.cast("string"))).alias("repo_list"))


@query("""with e as (select 'v' || s_nationkey as var, cast(s_suppkey as varchar) as value, 'r' || (s_suppkey % 13) as repo, s_suppkey as ord from supplier), v as (select var, arg_min(value, ord) as resolved_value from e group by 1),
x as (select var, repo, 1 as p, 0 as c from e where repo in ('r0', 'r1', 'r2', 'r3') union all select 'v' || c_nationkey, 'r' || (c_custkey % 4), 0, 1 from customer),
y as (select var, repo, max(p) as p, max(c) as c from x group by 1, 2) select var, cast(sum(p) as bigint) as producers, cast(sum(c) as bigint) as consumers, count(*) as repos, resolved_value from y join v using (var) group by var, resolved_value having count(*) >= 2 and sum(c) > 0""")
def env_binding(spark, d):
    s = _t(spark, d, "supplier")
    env = s.select(F.concat(F.lit("v"), F.col("s_nationkey").cast("string")).alias("name"), F.col("s_suppkey").cast("string").alias("value"), F.concat(F.lit("r"), (F.col("s_suppkey") % 13).cast("string"), F.lit("/.env")).alias("source_path"), F.col("s_suppkey").alias("ord"))
    roots = spark.createDataFrame([(f"r{i}", i) for i in range(4)], "root string, ord int")
    used = _t(spark, d, "customer").select(F.concat(F.lit("v"), F.col("c_nationkey").cast("string")).alias("var"), F.concat(F.lit("r"), (F.col("c_custkey") % 4).cast("string")).alias("repo"))
    return links.env_bindings(env, used, roots).select("var", "producers", "consumers", "repos", "resolved_value")


@query(r"""with i as (select page_id, lower(regexp_extract(url, '^[a-z]+://([^/:]+)', 1)) || '/' || regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1), '^/+|/+$', '', 'g'), '\.git$', '') as identity, regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1) as p from pages)
select page_id, identity from i where identity not in (select identity from i where page_id % 3 = 0)""")
def unscanned_upstream(spark, d):
    p = _t(spark, d, "pages")
    return links.unscanned_upstreams(p.select("page_id", F.col("url").alias("source_repo_url")), p.where("page_id % 3 = 0").select(F.col("url").alias("remote"))).select("page_id", "identity")


@query("""with u as (select distinct s_nationkey as repo, l_partkey as item from lineitem join supplier on l_suppkey = s_suppkey) select a.repo as left_repo, b.repo as right_repo, count(*) as shared from u a join u b on a.item = b.item and a.repo < b.repo group by 1, 2""")
def repo_pairs(spark, d):
    u = _t(spark, d, "lineitem").join(_t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("repo"), F.col("l_partkey").alias("item"))
    return joins.repo_pairs(u)


_BRAND = "lower(replace(p_brand, '#', ''))"
_DOT = _BRAND + " || '.' || replace(p_type, ' ', '.') || case when p_size % 3 = 0 then '.chains' when p_size % 3 = 1 then '.tools' else '' end || '.Cls' || p_size"
_KB = f"select distinct {_DOT} as id, {_BRAND} as framework, case when p_size % 2 = 0 then 'tool' else 'agent' end as concept from part where p_partkey % 2 = 0"
_OBS = f"select p_partkey as obs_id, case p_partkey % 5 when 0 then {_DOT} when 1 then split_part(p_type, ' ', 3) || case when p_size % 3 = 0 then '.chains' when p_size % 3 = 1 then '.tools' else '' end || '.Cls' || p_size when 2 then 'Cls' || p_size when 3 then 'cls' || p_size else {_BRAND} || '_x.Cls' || p_size || '.run' end as symbol, case when p_partkey % 4 = 1 then ['brand11', 'brand32'] else [] end as imported from part where p_partkey % 2 = 1"


@query(f"""with k as ({_KB}), o as ({_OBS}),
r as (select *, case when regexp_matches(id, '[.]chains[.]') then 2 when regexp_matches(id, '[.]tools[.]') and concept <> 'tool' then 1 else 0 end as score from k),
s as (select id, framework as kf, score, array_to_string(string_split(id, '.')[i:], '.') as suffix from (select id, framework, score, unnest(range(1, len(string_split(id, '.')) + 1)) as i from r)),
m as (select *, case when contains(symbol, '.') then split_part(symbol, '.', 1) else '' end as module from o),
pr as (select *, 2 as t, symbol as key from m union all select *, 3 as t, case when contains(symbol, '.') then regexp_extract(symbol, '.*(?:^|[.])([A-Z][^.]*)', 1) end as key from m),
j as (select obs_id, t, module = '' or split_part(split_part(module, '_', 1), '-', 1) = split_part(split_part(kf, '_', 1), '-', 1) as related, id, case when module <> '' and starts_with(kf, module) then 0 when list_contains(imported, kf) then 1 else 2 end as rank, score from pr join s on key = suffix where symbol not in (select id from k) and (contains(symbol, '.') or not regexp_matches(symbol, '^[a-z]'))),
ranked as (select *, row_number() over (partition by obs_id, t order by rank, case when rank = 2 then score else 0 end, id) as any_n, row_number() over (partition by obs_id, t, related order by rank, case when rank = 2 then score else 0 end, id) as rel_n from j),
best as (select obs_id, t, max(id) filter (any_n = 1) as any_id, bool_or(related) filter (any_n = 1) as any_related, max(id) filter (related and rel_n = 1) as near from ranked group by 1, 2),
found as (select obs_id, t, case when t = 2 and near is not null then 2 when t = 3 and any_related then 3 else 9 end as tier, case when t = 2 then coalesce(near, any_id) else any_id end as id from best)
select obs_id, 1 as tier, symbol as id from o where symbol in (select id from k) union all select obs_id, arg_min(tier, t), arg_min(id, t) from found group by 1""")
def suffix_catalog_match(spark, d):
    p, k, size = _t(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    brand, kind, cls = F.lower(F.translate("p_brand", "#", "")), F.translate("p_type", " ", "."), F.concat(F.lit("Cls"), size.cast("string"))
    path = F.when(size % 3 == 0, ".chains.").when(size % 3 == 1, ".tools.").otherwise(".")
    dotted = F.concat(brand, F.lit("."), kind, path, cls)
    kb = p.where("p_partkey % 2 = 0").select(dotted.alias("id"), brand.alias("framework"), F.when(size % 2 == 0, "tool").otherwise("agent").alias("concept")).distinct()
    symbol = F.when(k % 5 == 0, dotted).when(k % 5 == 1, F.concat(F.split_part("p_type", F.lit(" "), F.lit(3)), path, cls)).when(k % 5 == 2, cls).when(k % 5 == 3, F.lower(cls)).otherwise(F.concat(brand, F.lit("_x."), cls, F.lit(".run")))
    o = p.where("p_partkey % 2 = 1").select(k.alias("obs_id"), symbol.alias("symbol"), F.when(k % 4 == 1, F.array(F.lit("brand11"), F.lit("brand32"))).otherwise(F.array().cast("array<string>")).alias("imported"))
    return joins.match_catalogue(o, kb)


@query(f"""with k as (select *, case when id like '%0' then 'parameter' else 'c' end as label from ({_KB})), custom as (select 'own.' || replace(p_type, ' ', '.') || '.Cls' || p_size as id from part where p_partkey % 97 = 0),
s as (select distinct 'z.Cls' || p_size as symbol from part where p_size % 5 = 0 union select id from k where id like '%1%Cls2' union select 'Cls7'),
db as (select distinct id from k where label <> 'parameter' and ((id in (select symbol from s)) or split_part(id, '.', -1) in (select split_part(symbol, '.', -1) from s))),
cu as (select distinct c.id from custom c join s on case when contains(symbol, '.') then c.id = symbol or ends_with(c.id, '.' || symbol) else split_part(c.id, '.', -1) = symbol end)
select id from (from db union select id from cu where id not in (from db)) where not ends_with(id, 'Cls10')""")
def catalog_lookup(spark, d):
    p, size = _t(spark, d, "part"), F.col("p_size")
    brand, kind, cls = F.lower(F.translate("p_brand", "#", "")), F.translate("p_type", " ", "."), F.concat(F.lit("Cls"), size.cast("string"))
    dotted = F.concat(brand, F.lit("."), kind, F.when(size % 3 == 0, ".chains.").when(size % 3 == 1, ".tools.").otherwise("."), cls)
    k = p.where("p_partkey % 2 = 0").select(dotted.alias("id")).distinct().withColumn("label", F.when(F.col("id").endswith("0"), "parameter").otherwise("c"))
    s = p.where("p_size % 5 = 0").select(F.concat(F.lit("z."), cls).alias("symbol")).unionByName(k.where("id like '%1%Cls2'").select(F.col("id").alias("symbol"))).unionByName(spark.createDataFrame([("Cls7",)], "symbol string"))
    custom = p.where("p_partkey % 97 = 0").select(F.concat(F.lit("own."), kind, F.lit("."), cls).alias("id"), F.lit("custom").alias("label"))
    return joins.catalogue_lookup(k, s, ["Cls10"], custom).select("id")


@query("""with r(root, ord) as (values ('src1', 0), ('src1/en', 1), ('src2', 2), ('src3/fr', 3), ('src3', 4)), f as (select source || '/' || lang || '/' || doc_id as path from documents)
select path, arg_min(root, ord) as root from f join r on path = root or starts_with(path, root || '/') group by 1""")
def prefix_root(spark, d):
    f = _t(spark, d, "documents").select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    r = spark.createDataFrame([("src1", 0), ("src1/en", 1), ("src2", 2), ("src3/fr", 3), ("src3", 4)], "root string, ord int")
    return joins.root_of(f, r)


@query("""select a.user_id, a.event_id as l, b.event_id as r from events a join events b on a.user_id = b.user_id and abs(a.event_id - b.event_id) <= 500 where a.event_type = 'click' and b.event_type = 'view'""")
def band_merge_candidates(spark, d):
    e = _t(spark, d, "events")
    return joins.near_lines(e.where("event_type = 'click'"), e.where("event_type = 'view'"), "user_id", "event_id", 500)


@query("""with s as (select user_id, event_id as lo, event_id + 2000 as hi, event_id as name from events where event_type = 'signup') select e.event_id, arg_min(s.name, s.lo) as enclosing from events e join s on e.user_id = s.user_id and e.event_id between lo and hi group by 1""")
def enclosing_interval(spark, d):
    e = _t(spark, d, "events")
    s = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("lo"), (F.col("event_id") + 2000).alias("hi"), F.col("event_id").alias("name"))
    return joins.enclosing(e, s, "user_id", "event_id", "lo", "hi", "name", ["event_id"])


@query("""select event_id, user_id, coalesce(last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row), first_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and unbounded following)) as site from events""")
def nearest_preceding_site(spark, d):
    e = _t(spark, d, "events")
    return joins.nearest_preceding(e, "user_id", "event_id", F.col("event_type") == "signup", F.col("event_id")).select("event_id", "user_id", "site")


_DIFF = """with o as (select o_custkey as name, o_orderpriority as component_type, arg_max(o_orderstatus, o_orderkey) as s, arg_max(cast(o_totalprice as bigint) % 3, o_orderkey) as p from orders where o_orderdate < timestamp '1996-01-01' group by 1, 2),
n as (select o_custkey as name, o_orderpriority as component_type, arg_max(o_orderstatus, o_orderkey) as s, arg_max(cast(o_totalprice as bigint) % 3, o_orderkey) as p from orders where o_orderdate >= timestamp '1996-01-01' group by 1, 2),
x as (select coalesce(o.name, n.name) as name, coalesce(o.component_type, n.component_type) as component_type, case when o.name is null then 'added' when n.name is null then 'removed' when o.s <> n.s or o.p <> n.p then 'changed' else 'same' end as change, concat_ws(',', case when o.s <> n.s then 's' end, case when o.p <> n.p then 'p' end) as f from o full join n on o.name = n.name and o.component_type = n.component_type) """


def _snapshots(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderpriority").alias("component_type"), F.col("o_orderstatus").alias("s"), (F.round(F.col("o_totalprice")).cast("long") % 3).alias("p"), F.col("o_orderkey").alias("ord"), "o_orderdate")
    cut = F.lit("1996-01-01").cast("timestamp_ntz")
    return compare.diff(o.where(F.col("o_orderdate").cast("timestamp_ntz") < cut), o.where(F.col("o_orderdate").cast("timestamp_ntz") >= cut), ["name", "component_type"], ["s", "p"])


_DIFF = _DIFF.replace("cast(o_totalprice as bigint) % 3", "cast(round(o_totalprice) as bigint) % 3")


@query(_DIFF + "select name, component_type, change, case when change = 'changed' then f else '' end as fields from x")
def inventory_diff(spark, d):
    return _snapshots(spark, d)


@query(_DIFF + "select component_type, count(*) filter (change = 'added') as added, count(*) filter (change = 'removed') as removed, count(*) filter (change = 'changed') as changed, count(*) filter (change = 'same') as same from x group by 1")
def inventory_diff_summary(spark, d):
    return compare.diff_summary(_snapshots(spark, d), "component_type")


_FLAG = "case o_orderpriority when '1-URGENT' then 'hardcoded_api_key' when '2-HIGH' then 'mcp_unknown_server' when '3-MEDIUM' then 'shadow_ai' else 'unpinned_model' end"


@query(f"""with f as (select o_custkey as source, {_FLAG} as flag from orders), w as (select source, case flag when 'hardcoded_api_key' then 35 when 'mcp_unknown_server' then 25 when 'shadow_ai' then 20 else 10 end as weight, case flag when 'hardcoded_api_key' then 3 when 'mcp_unknown_server' then 3 when 'shadow_ai' then 2 else 1 end as r from f)
select *, case when score >= 76 then 'critical' when score >= 51 then 'high' when score >= 26 then 'medium' when score > 0 then 'low' else 'info' end as severity from (select source, cast(least(100, sum(weight)) as int) as score, count(*) as flags, max(r) as worst from w group by 1)""")
def risk_score(spark, d):
    p = F.col("o_orderpriority")
    flag = F.when(p == "1-URGENT", "hardcoded_api_key").when(p == "2-HIGH", "mcp_unknown_server").when(p == "3-MEDIUM", "shadow_ai").otherwise("unpinned_model")
    return assess.risk_score(assess.weighted(_t(spark, d, "orders").select(F.col("o_custkey").alias("source"), flag.alias("flag"))), "source")


def _inventory(spark, d):
    """Parts as an inventory for checks, lineitems as its edges."""
    p = _t(spark, d, "part")
    kind = F.element_at(F.array(*map(F.lit, ("model", "agent", "tool", "mcp_server", "secret", "dataset", "guardrail", "training_run"))), (F.col("p_partkey") % 8 + 1).cast("int"))
    c = p.select(
        F.lit("s").alias("source"), F.col("p_name").alias("name"), kind.alias("component_type"), F.lit("a.py").alias("file_path"), F.col("p_size").alias("line_number"),
        F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_brand")).alias("framework"), F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise(F.concat(F.lit("m-v"), F.col("p_size").cast("string"), F.lit(".0"))).alias("model_name"),
        F.lit("d").alias("description"), F.lit("").alias("dataset_source"), F.lit(0.9).alias("heuristic_confidence"), F.lit(None).cast("double").alias("agentic_confidence"), (F.col("p_size") > 48).alias("needs_agentic"),
        F.create_map(F.lit("risk_flags"), F.when(F.col("p_size") == 7, "no_auth,unknown").otherwise("")).alias("metadata"), F.col("p_partkey").cast("string").alias("instance_id"))
    r = _t(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("source_instance_id"), F.col("l_partkey").cast("string").alias("target_instance_id"), F.when(F.col("l_returnflag") == "R", "USES_TOOL").otherwise("USES_GUARDRAIL").alias("relationship_type"))
    return c, r


_KINDS = "['model', 'agent', 'tool', 'mcp_server', 'secret', 'dataset', 'guardrail', 'training_run'][p_partkey % 8 + 1]"
_INV = f"""with c as (select cast(p_partkey as varchar) as id, p_name as name, {_KINDS} as t, case when p_size % 2 = 0 then '' else p_brand end as framework, case when p_size % 3 = 0 then p_type else 'm-v' || p_size || '.0' end as model_name, p_size > 48 as needs, p_size from part),
r as (select cast(l_suppkey as varchar) as s, cast(l_partkey as varchar) as d, case when l_returnflag = 'R' then 'USES_TOOL' else 'USES_GUARDRAIL' end as k from lineitem),
q as (select *, contains(model_name, '/') or regexp_matches(model_name, '\\d+\\.\\d+|==\\s*[\\w.\\-]+|@[\\w.\\-]+') or len(list_filter(regexp_split_to_array(model_name, '[-_:]'), lambda x: regexp_matches(x, '^[0-9]{{4,}}$'))) > 0 as pinned from c) """


@query(_INV + """, g as (select s as a, d as b from r where k = 'USES_GUARDRAIL' union select d, s from r where k = 'USES_GUARDRAIL'), x as (select *, exists (select 1 from r where r.s = q.id and k = 'USES_GUARDRAIL') as guards, exists (select 1 from r where r.d = q.id and k = 'USES_TOOL') as used, exists (select 1 from g join c c2 on g.b = c2.id and c2.t = 'guardrail' where g.a = q.id) as guarded from q)
select * from (select unnest(['eu-1', 'eu-2', 'eu-3', 'eu-4', 'eu-5', 'owasp-1', 'owasp-2', 'owasp-3', 'owasp-4', 'owasp-5', 'nist-1', 'nist-2', 'nist-3', 'nist-4', 'nist-5']) as requirement, unnest([
 case when not bool_or(t = 'model') then 'not_applicable' else 'pass' end,
 case when not bool_or(t = 'training_run') then 'not_applicable' when bool_or(t = 'dataset') then 'pass' else 'fail' end, 'fail',
 case when not bool_or(t = 'agent') then 'not_applicable' when bool_or(t = 'agent' and not guards) then 'fail' else 'pass' end,
 case when bool_or(needs) then 'fail' else 'pass' end,
 case when not bool_or(t = 'agent') then 'not_applicable' else 'pass' end,
 case when not bool_or(t = 'tool') then 'not_applicable' when bool_or(t = 'tool' and not used) then 'fail' else 'pass' end,
 case when not bool_or(t = 'mcp_server') then 'not_applicable' when bool_or(t = 'mcp_server' and not guarded) then 'fail' else 'pass' end,
 case when bool_or(t = 'secret') then 'fail' else 'not_applicable' end,
 case when not bool_or(t = 'agent') then 'not_applicable' else 'fail' end,
 case when bool_or(t <> 'other') then 'pass' else 'fail' end,
 case when not bool_or(t = 'model') then 'not_applicable' when bool_or(t = 'model' and not pinned) then 'fail' else 'pass' end,
 case when bool_or(t = 'dataset') then 'fail' else 'not_applicable' end,
 case when not bool_or(t = 'agent') then 'not_applicable' else 'fail' end, 'fail']) as status from x)""")
def compliance_matrix(spark, d):
    return assess.compliance(*_inventory(spark, d))


@query(_INV + """select 'no_hardcoded_keys' as rule, 'critical' as severity, name as subject from q where t = 'secret' union all select 'require_pinned_models', 'high', name from q where t = 'model' and not pinned union all select 'blocked_models', 'low', name from q where t = 'model' and contains(lower(model_name), 'promo') union all select 'max_unresolved_agentic', 'medium', 'unresolved' from q having count(*) filter (needs) > 3 union all select 'require_observability_for', 'medium', unnest(['agent', 'tool']) union all select 'max_risk_score', 'high', 'score'""")
def policy_violations(spark, d):
    rules, _ = assess.load_policy({"rules": [{"rule": "no_hardcoded_keys"}, {"rule": "require_pinned_models"}, {"rule": "blocked_models", "params": {"models": ["PROMO"]}, "severity": "low"}, {"rule": "max_unresolved_agentic", "params": {"max": 3}}, {"rule": "require_observability_for", "params": {"component_types": ["agent", "tool", "skill"]}}, {"rule": "require_guardrail_for", "params": {"component_types": ["agent"]}}, {"rule": "max_risk_score", "params": {"threshold": 50}}]})
    return assess.policy_violations(_inventory(spark, d)[0], rules, score=51)


@query(_INV + """select flag, count(*) as n from (select 'hardcoded_api_key' as flag from q where t = 'secret' union all select 'mcp_unknown_server' from q where t = 'mcp_server' and framework = '' union all select 'unpinned_model' from q where t = 'model' and not pinned union all select 'no_auth' from q where p_size = 7) group by 1""")
def risk_flags(spark, d):
    return assess.risk_flags(_inventory(spark, d)[0]).groupBy("flag").agg(F.count("*").alias("n"))


@query("""with t as (select quality as category, doc_id as name from labels), f as (select case when n_chars > 600 then 1 else 0 end as category, doc_id as name from documents join labels using (doc_id)), j as (select coalesce(t.category, f.category) as category, t.name as a, f.name as b from t full join f on t.category = f.category and t.name = f.name),
c as (select category, count(b) as detected, count(*) filter (a is not null and b is not null) as tp, count(*) filter (a is null) as fp, count(*) filter (b is null) as fn from j group by 1), m as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as p, case when tp + fn > 0 then tp / (tp + fn) else 0.0 end as r from c)
select category, detected, tp, fp, fn, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end, 6) as f1 from m""")
def detection_prf(spark, d):
    l = _t(spark, d, "labels")
    truth = l.select(F.col("quality").alias("category"), F.col("doc_id").cast("string").alias("name"))
    found = _t(spark, d, "documents").join(l.select("doc_id"), "doc_id").select((F.col("n_chars") > 600).cast("int").alias("category"), F.col("doc_id").cast("string").alias("name"))
    return compare.benchmark_names(truth, found)


@query("""with t as (select p_brand as category, count(*) - 5 as expected from part where p_partkey % 3 <> 0 group by 1), f as (select p_brand as category, count(*) as detected from part where p_partkey % 4 <> 0 group by 1), c as (select coalesce(t.category, f.category) as category, coalesce(expected, 0) as expected, coalesce(detected, 0) as detected from t full join f on t.category = f.category),
k as (select *, least(expected, detected) as tp, greatest(detected - expected, 0) as fp, greatest(expected - detected, 0) as fn from c), m as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as p, case when tp + fn > 0 then tp / (tp + fn) else 0.0 end as r from k)
select category, expected, detected, tp, fp, fn, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end, 6) as f1 from m""")
def detection_counts(spark, d):
    p = _t(spark, d, "part").withColumn("category", F.col("p_brand"))
    truth = p.where("p_partkey % 3 <> 0").groupBy("category").agg((F.count("*") - 5).alias("expected"))
    return compare.benchmark_counts(truth, p.where("p_partkey % 4 <> 0"))


@query("""with n as (select p_type as component_type, count(*) as n from part where p_size % 9 <> 0 group by 1) select component_type, n, round(100 * n / max(n) over (), 2) as pct from n""")
def type_summary(spark, d):
    return assess.type_breakdown(_t(spark, d, "part").select(F.col("p_type").alias("component_type"), (F.col("p_size") % 9 == 0).alias("test_only")))


@query(r"""with u as (select page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) as h, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as p from pages)
select page_id, case page_id % 9 when 0 then 'https://' || lower(h) when 1 then 'http://' || lower(h) || ':8080/x' when 2 then 'https://' || lower(h) || '/pre' when 3 then 'https://' || lower(h) || '/' when 5 then 'http://' || lower(h) || '/a/b' when 6 then 'https://' || lower(h) || '/q' when 7 then 'https://' || lower(h) || case when p = '/' then p else rtrim(p, '/') end end as canonical from u""")
def url_canonical(spark, d):
    k, h, p = F.col("page_id") % 9, F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1), F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    join = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    url = (F.when(k == 0, join("HTTPS://u:p@", F.upper(h), ":443/.well-known/AGENT.json?x=1")).when(k == 1, join(" http://", h, ":8080/x///")).when(k == 2, join("https://", h, "/pre/.well-known/agent-card.json#f"))
           .when(k == 3, join("https://", h, "/")).when(k == 4, join("ftp://", h, "/x")).when(k == 5, join("http://", h, ":80/a/b;v=1?q")).when(k == 6, join("https://me@", h, "/q/")).when(k == 7, join("https://", h, p)).otherwise(F.lit("no url")))
    return _t(spark, d, "pages").select("page_id", X.canonical_url(url).alias("canonical"))


@query("""select s_suppkey, case s_suppkey % 9 when 0 then 'github.com/Org/R' || s_suppkey when 1 then 'git.x.io/g/R' || s_suppkey when 2 then 'github.com/org/r' when 3 then 'host.only' when 4 then 'gitlab.com/a/b.c' when 5 then 'h/p/q' when 6 then 'h/a/b' when 7 then 'h.io' end as identity from supplier""")
def git_canonical(spark, d):
    k, n = F.col("s_suppkey") % 9, F.col("s_suppkey").cast("string")
    ref = (F.when(k == 0, F.concat(F.lit("git@GitHub.com:Org/R"), n, F.lit(".git"))).when(k == 1, F.concat(F.lit("https://tok:x@Git.x.io:8443/g/R"), n, F.lit(".git/"))).when(k == 2, "github.com:org/r")
           .when(k == 3, "Host.Only").when(k == 4, "ssh://git@gitlab.com:22/a/b.c").when(k == 5, "H/p/q/").when(k == 6, "h:a\\b.git").when(k == 7, "https://H.io").otherwise(""))
    return _t(spark, d, "supplier").select("s_suppkey", X.canonical_git(ref).alias("identity"))


@query("""select s_suppkey, case s_suppkey % 8 when 0 then 'docker.io/library/python' when 1 then 'ghcr.io/A/b' when 2 then 'docker.io/a/b' when 3 then 'localhost/x' when 4 then 'reg.io:5000/x/y' when 5 then 'docker.io/library/x' when 6 then 'docker.io' end as image from supplier""")
def image_canonical(spark, d):
    k = F.col("s_suppkey") % 8
    ref = (F.when(k == 0, "python:3.12@sha256:ab").when(k == 1, " GHCR.io/A/b:1 ").when(k == 2, "a/b").when(k == 3, "localhost/x:t").when(k == 4, "reg.io:5000/x/y@sha256:0").when(k == 5, "docker.io/x").when(k == 6, "docker.io/:t").otherwise(""))
    return _t(spark, d, "supplier").select("s_suppkey", X.canonical_image(ref).alias("image"))


_HOSTS = ("abc.pinecone.io", "x.openai.azure.com", "api.groq.com", "bedrock-runtime-fips.us-east-1.amazonaws.com", "europe-west1-aiplatform.googleapis.com", "example.com", "api.deepinfra.com", "mistral.example.com")


@query(f"""with u as (select page_id, {list(_HOSTS)}[page_id % 8 + 1] as h, ['vector_url', 'CHAT_BASE', 'api_base', 'retriever', 'gpt'][page_id % 5 + 1] as k, case page_id % 7 when 0 then 'embedding' when 1 then 'llm' end as m from pages)
select page_id, case when h = 'abc.pinecone.io' then 'vector_store' when h not in ('example.com', 'mistral.example.com') then 'llm_endpoint' when m = 'embedding' then 'model_endpoint' when m = 'llm' then 'llm_endpoint' when k in ('CHAT_BASE', 'gpt') then 'llm_endpoint' else 'model_endpoint' end as kind from u""")
def classify_endpoint(spark, d):
    k = F.col("page_id")
    pick = lambda n, *x: F.element_at(F.array(*map(F.lit, x)), (k % n + 1).cast("int"))
    url = F.concat(F.lit("https://"), pick(8, *_HOSTS), F.lit("/v1"))
    return _t(spark, d, "pages").select("page_id", X.classify_endpoint(url, pick(5, "vector_url", "CHAT_BASE", "api_base", "retriever", "gpt"), F.when(k % 7 == 0, "embedding").when(k % 7 == 1, "llm")).alias("kind"))


_PINS = ("org/m", "gpt-3.5turbo", "m==abc", "llama@latest", "m-2024", "m-123", "v1.2", "", " / ", "m_20240101:x", "gpt-4o")


@query(f"""select p_partkey, {[True, True, True, True, True, False, True, False, True, True, False]}[p_partkey % 12 + 1] and p_partkey % 12 < 11 as pinned from part""")
def pin_check(spark, d):
    k = F.col("p_partkey")
    m = F.when(k % 12 < 11, F.element_at(F.array(*map(F.lit, _PINS)), (F.least(k % 12, F.lit(10)) + 1).cast("int")))
    return _t(spark, d, "part").select("p_partkey", X.is_model_pinned(m).alias("pinned"))


_PATHS = (("a/tests/b.py", True, False), ("a/spec/b.py", False, False), ("Test_x.py", True, False), ("a/b_TEST.py", True, False), ("deploy/env/prod.yaml", False, False), ("x/site-packages/y.py", False, True), ("my-VENV/y.py", False, True), ("a.egg-info/z", False, True), ("a/build", False, False), (".eggs/x", False, True), ("testing/fixtures/x.py", False, False), ("/a/__tests__/x", True, False))


@query(f"""select doc_id, {[t for _, t, _ in _PATHS]}[doc_id % 12 + 1] as is_test, {[s for *_, s in _PATHS]}[doc_id % 12 + 1] as skipped from documents""")
def file_scope(spark, d):
    path = F.element_at(F.array(*(F.lit(p) for p, *_ in _PATHS)), (F.col("doc_id") % 12 + 1).cast("int"))
    return _t(spark, d, "documents").select("doc_id", X.is_test_path(path).alias("is_test"), X.in_skipped_dir(path).alias("skipped"))


@query("""select doc_id, i as line, substr(l, 1, 200) as context from (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) where regexp_matches(l, '(?i)token|example')""")
def search_codebase(spark, d):
    from inventra.operators.search import search_lines

    return search_lines(_t(spark, d, "documents").withColumnRenamed("text", "content"), "(?i)token|example", ["doc_id"]).select("doc_id", "line", "context")


@query("""with recursive e as (select distinct conv_id * 1000 + turn as caller, conv_id * 1000 + turn + 1 as callee from conversations), w(start, node, distance) as (select conv_id * 1000 + 5, conv_id * 1000 + 5, 0 from conversations where turn = 5 union select start, e.caller, distance + 1 from w join e on w.node = e.callee where distance < 4) select start, node as caller, min(distance) as distance from w where distance > 0 group by 1, 2""")
def call_chain(spark, d):
    c = _t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("caller"), (F.col("conv_id") * 1000 + F.col("turn") + 1).alias("callee"), "turn")
    out = graph.callers_within(c, c.where("turn = 5").select(F.col("caller").alias("name")), 4)
    return out.select("start", "caller", F.col("distance").cast("int").alias("distance"))


@query("""select doc_id, (row_number() over (order by source, lang, doc_id) - 1) // 7 as batch from documents""")
def locality_batches(spark, d):
    return agentic.batches(_t(spark, d, "documents"), 7, "source", ["lang", "doc_id"]).select("doc_id", "batch")


@query("""select p_partkey, (p_partkey % 3 = 0 and p_size % 2 = 0) or (p_partkey % 3 < 2 and p_size % 5 <> 0 and p_size % 7 <> 0) as simple from part""")
def candidate_split(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    c = _t(spark, d, "part").select("p_partkey", F.when(k % 3 == 0, "dependency").when(k % 3 == 1, "model").otherwise("tool").alias("component_type"), F.when(s % 5 == 0, "").otherwise("m").alias("model_name"), F.create_map(F.lit("known_ai_package"), F.when(s % 2 == 0, "true").otherwise("false"), F.lit("env"), F.when(s % 7 == 0, "X").otherwise("")).alias("metadata"))
    return c.select("p_partkey", F.coalesce(agentic.is_simple(c), F.lit(False)).alias("simple"))


@query("""select p_name as name, p_type as component_type, coalesce(nullif(p_brand, ''), '') as file_path, p_size as line_number, '' as framework, 'code' as detection_source, '' as model_name, case when p_partkey % 2 = 0 then p_name else '' end as description, cast(p_partkey as varchar) as instance_id from part""")
def csv_projection(spark, d):
    from inventra.sinks.reports import csv_rows

    none = F.lit(None).cast("string")
    c = _t(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("component_type"), none.alias("framework"), F.col("p_brand").alias("file_path"), F.col("p_size").alias("line_number"), F.lit("code").alias("detection_source"), none.alias("model_name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("description"), F.col("p_partkey").cast("string").alias("instance_id"))
    return csv_rows(c)


@query("""select p_brand as source, p_type as component_type, count(*) as n, string_agg(p_name, '|' order by p_name, p_partkey) as names from part group by 1, 2""")
def json_report(spark, d):
    from inventra.sinks.reports import grouped

    c = _t(spark, d, "part").select(F.col("p_brand").alias("source"), F.col("p_type").alias("component_type"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"))
    return grouped(c).select("source", "component_type", F.size("components").cast("long").alias("n"), F.concat_ws("|", F.transform("components", lambda x: x["name"])).alias("names"))


_EXPORT = "select case p_partkey % 8 when 0 then 'model' when 1 then 'agent' when 2 then 'tool' when 3 then 'secret' when 4 then 'dataset' when 5 then 'skill' when 6 then 'training_run' else 'memory' end as t, p_name as name, case when p_size % 2 = 0 then '' else p_brand end as fw, case when p_size % 3 = 0 then '' else 'f.py' end as f, p_size % 5 as line, case when p_size % 4 = 0 then 'd' end as descr, cast(p_partkey as varchar) as id, p_type from part"


def _exported(spark, d):
    k, size = F.col("p_partkey") % 8, F.col("p_size")
    kind = F.element_at(F.array(*map(F.lit, ("model", "agent", "tool", "secret", "dataset", "skill", "training_run", "memory"))), (k + 1).cast("int"))
    return _t(spark, d, "part").select(F.lit("s").alias("source"), kind.alias("component_type"), F.col("p_name").alias("name"), F.when(size % 2 == 0, "").otherwise(F.col("p_brand")).alias("framework"), F.when(size % 3 == 0, "").otherwise("f.py").alias("file_path"), (size % 5).alias("line_number"), F.when(size % 4 == 0, "d").alias("description"), F.col("p_type").alias("model_name"), F.col("p_partkey").cast("string").alias("instance_id"), F.col("p_partkey").alias("ord"))


@query(f"""select 'urn:spdx:asset-' || t || '-' || sha256(id) as id, case when t in ('model', 'training_run') then 'ai_AIPackage' when t = 'dataset' then 'dataset_DatasetPackage' else 'software_Package' end as element, name, case when t in ('model', 'training_run') then p_type when t = 'dataset' then coalesce(descr, name) when t in ('agent', 'skill') then 'application' when t = 'tool' then 'library' else 'data' end as purpose from ({_EXPORT})""")
def spdx_ids(spark, d):
    from inventra.sinks.reports import spdx_rows

    return spdx_rows(_exported(spark, d))


@query(f"""select id as ref, name, case t when 'secret' then 'vulnerability' when 'model' then 'machine-learning-model' when 'tool' then 'library' when 'dataset' then 'data' when 'skill' then 'file' else 'application' end as class, coalesce(descr, name || ' — ' || t || case when fw <> '' then ' — ' || fw else '' end) as description, concat_ws('|', case when t not in ('model', 'dataset') then 'type=' || t end, case when fw <> '' then 'framework=' || fw end, case when f <> '' then 'file_path=' || f end, case when line > 0 then 'line_number=' || line end) as properties from ({_EXPORT})""")
def cyclonedx_report(spark, d):
    from inventra.sinks.reports import cyclonedx_rows

    return cyclonedx_rows(_exported(spark, d)).withColumn("properties", F.concat_ws("|", "properties"))


@query(f"""select 'asset/' || t as rule, case when t = 'secret' then 'warning' else 'note' end as level, concat_ws(' ', 'component ' || chr(39) || name || chr(39) || ' (' || t || ')', case when fw <> '' then 'framework: ' || fw end, descr) as message, nullif(f, '') as file, case when f <> '' and line > 0 then line end as line from ({_EXPORT})
union all select 'asset/risk/' || case event_type when 'view' then 'no-auth' else event_type end, case when event_type = 'view' then 'error' when event_type = 'click' then 'warning' else 'note' end, case when event_type = 'view' then 'No Auth!' else event_type end, 'e.py', case when event_id % 2 = 0 then 7 end from events""")
def sarif_report(spark, d):
    from inventra.sinks.reports import sarif_rows

    e, t = _t(spark, d, "events"), F.col("event_type")
    flags = e.select(F.when(t == "view", "No Auth!").otherwise(t).alias("flag"), F.when(t == "view", "critical").when(t == "click", "medium").otherwise("low").alias("severity"), F.lit("e.py").alias("file_path"), F.when(F.col("event_id") % 2 == 0, 7).otherwise(0).alias("line_number"))
    return sarif_rows(_exported(spark, d), flags)


@query(f"""select 'risk' as class, 'risk_' || event_type as "case", event_type in ('view', 'click') as failed from events union all select 'component', 'component_' || id, false from ({_EXPORT}) where not (f = 'f.py' and line = 3)""")
def junit_report(spark, d):
    from inventra.sinks.reports import junit_rows

    t = F.col("event_type")
    flags = _t(spark, d, "events").select(t.alias("flag"), F.when(t == "view", "critical").when(t == "click", "medium").otherwise("low").alias("severity"), F.lit("f.py").alias("file_path"), F.lit(3).alias("line_number"))
    return junit_rows(_exported(spark, d), flags)


@query("""select count(distinct p_brand) as sources, count(*) filter (p_size % 9 <> 0) as components, count(*) filter (p_size % 9 = 0) as test_only, count(*) filter (p_partkey % 3 = 0) as pending from part""")
def inventory_totals(spark, d):
    from inventra.sinks.reports import totals

    return totals(_t(spark, d, "part").select(F.col("p_brand").alias("source"), (F.col("p_size") % 9 == 0).alias("test_only"), (F.col("p_partkey") % 3 == 0).alias("needs_agentic")))


@query("""select event_type as var, count(*) as n from events where event_type not in (select distinct event_type from events where event_id % 2 = 0 and event_type < 'f') group by 1""")
def undefined_refs(spark, d):
    e = _t(spark, d, "events")
    env = e.where("event_id % 2 = 0 and event_type < 'f'").select(F.col("event_type").alias("name"), F.lit("").alias("value"), F.lit("e").alias("source_type"), F.lit("p").alias("source_path"), F.col("event_id").alias("ord"))
    return links.undefined_refs(e.select(F.col("event_type").alias("var")), env).groupBy("var").agg(F.count("*").alias("n"))


@query("""with a as (select expected, coalesce(predicted, 'abstain') as predicted, count(*) as n from (select doc_id, case quality when 1 then 'keep' else 'remove' end as expected from labels) e left join (select doc_id, case when n_chars > 600 then 'keep' else 'remove' end as predicted from documents where doc_id % 5 <> 0) p using (doc_id) group by 1, 2) select * from a""")
def action_confusion(spark, d):
    e = _t(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "keep").otherwise("remove").alias("expected"))
    p = _t(spark, d, "documents").where("doc_id % 5 <> 0").select("doc_id", F.when(F.col("n_chars") > 600, "keep").otherwise("remove").alias("predicted"))
    return compare.confusion(e, p, "doc_id")


@query(r"""with e as (select 'V' || (s_suppkey % 40) as name, case s_suppkey % 5 when 0 then '' when 1 then 'gpt-' || (s_suppkey % 4) when 2 then 'https://h/' || s_suppkey when 3 then 'm-${V' || (s_suppkey % 40 + 1) || '}' else 'x-${NONE}' end as value, s_suppkey as ord from supplier), v as (select name, arg_min(value, ord) as value from e group by 1),
c as (select p_partkey, case when p_partkey % 3 = 0 then 'env:V' || (p_partkey % 50) else 'n' || p_partkey end as name, ['model', 'embedding', 'vector_store', 'llm_endpoint', 'tool'][p_partkey % 5 + 1] as t, case when p_partkey % 4 = 0 then 'own-1' end as m, 'V' || (p_partkey % 50) as env, p_partkey % 2 = 0 as needs from part),
j as (select c.*, v.name is not null as got, v.value, coalesce(v.value, '') <> '' as has from c left join v on c.env = v.name),
k as (select *, case when got and t = 'llm_endpoint' and has then value when got and t not in ('vector_store') and m is null and has then value else m end as m1 from j),
l as (select k.*, case when m1 like 'm-${%' then coalesce('m-' || s.value, m1) else m1 end as m2 from k left join v s on s.name = regexp_extract(m1, '\$\{([^}]+)\}', 1)),
a as (select *, got and coalesce(m2, '') <> '' and not regexp_matches(coalesce(m2, ''), '\$\{[^}]+\}') as asked, coalesce(m2 in ('gpt-1', 'gpt-2'), false) as hit, case when got and (t = 'vector_store' or (t = 'llm_endpoint' and has)) then 0.8 else 0.3 end as conf from l)
select p_partkey, case when starts_with(name, 'env:') and t in ('model', 'embedding') and coalesce(m2, '') <> '' and not starts_with(m2, 'http') and not regexp_matches(m2, '\$\{[^}]+\}') then m2 else name end as name, m2 as model_name, case when asked and hit then greatest(conf, 0.85) when asked then greatest(conf, 0.5) else conf end as heuristic_confidence, case when asked then not hit when got and t = 'vector_store' then false else needs end as needs_agentic, case when asked and hit then '' when asked then 'not_in_registry' when not got and needs then 'undefined_variable' else 'h' end as agentic_hint from a""")
def resolve_references(spark, d):
    s, k = F.col("s_suppkey"), F.col("p_partkey")
    var = lambda n: F.concat(F.lit("V"), n.cast("string"))
    value = F.when(s % 5 == 0, "").when(s % 5 == 1, F.concat(F.lit("gpt-"), (s % 4).cast("string"))).when(s % 5 == 2, F.concat(F.lit("https://h/"), s.cast("string"))).when(s % 5 == 3, F.concat(F.lit("m-${V"), (s % 40 + 1).cast("string"), F.lit("}"))).otherwise("x-${NONE}")
    env = _t(spark, d, "supplier").select(var(s % 40).alias("name"), value.alias("value"), F.lit("dotenv").alias("source_type"), F.lit(".env").alias("source_path"), s.alias("ord"))
    kind = F.element_at(F.array(*map(F.lit, ("model", "embedding", "vector_store", "llm_endpoint", "tool"))), (k % 5 + 1).cast("int"))
    c = _t(spark, d, "part").select("p_partkey", F.when(k % 3 == 0, F.concat(F.lit("env:"), var(k % 50))).otherwise(F.concat(F.lit("n"), k.cast("string"))).alias("name"), kind.alias("component_type"), F.when(k % 4 == 0, "own-1").alias("model_name"), F.lit(0.3).alias("heuristic_confidence"), (k % 2 == 0).alias("needs_agentic"), F.lit("h").alias("agentic_hint"), F.create_map(F.lit("env"), var(k % 50)).alias("metadata"))
    out = joins.resolve(c, env, spark.createDataFrame([("gpt-1",), ("GPT-2",)], "model string"))
    return out.select("p_partkey", "name", "model_name", "heuristic_confidence", "needs_agentic", "agentic_hint")


@query("""with e as (select event_id, user_id, event_id // 40 as line, case event_type when 'view' then 'kb_enrichment' when 'click' then 'code_analysis' when 'error' then 'other' else 'config_file' end as source, event_id % 11 <> 0 as model from events),
n as (select user_id, line, event_id from e where model and source in ('code_analysis', 'config_file')), k as (select user_id, line, event_id from e where model and source = 'kb_enrichment'),
near as (select user_id, n.event_id as n, list(k.event_id order by k.event_id) as ks from n join k using (user_id) where abs(n.line - k.line) <= 5 group by 1, 2),
seq as (select *, row_number() over (partition by user_id order by n) as i from near),
walk as (with recursive w(user_id, i, used, n, pick) as (select distinct user_id, 0::bigint, []::bigint[], null::bigint, null::bigint from seq union all select w.user_id, s.i, case when len(list_filter(s.ks, lambda x: not list_contains(w.used, x))) > 0 then list_append(w.used, list_filter(s.ks, lambda x: not list_contains(w.used, x))[1]) else w.used end, s.n, list_filter(s.ks, lambda x: not list_contains(w.used, x))[1] from w join seq s on s.user_id = w.user_id and s.i = w.i + 1) select n, pick from w where pick is not null)
select e.event_id, w.pick as took from e left join walk w on w.n = e.event_id where e.event_id not in (select pick from walk)""")
def greedy_merge_sites(spark, d):
    k, t = F.col("event_id"), F.col("event_type")
    source = F.when(t == "view", "kb_enrichment").when(t == "click", "code_analysis").when(t == "error", "other").otherwise("config_file")
    e = _t(spark, d, "events").select(F.col("user_id").cast("string").alias("file_path"), F.floor(k / 40).cast("int").alias("line_number"), k.alias("ord"), k.cast("string").alias("name"), F.lit("").alias("framework"), source.alias("detection_source"), F.when(k % 11 != 0, "model").otherwise("tool").alias("component_type"), F.when(t != "view", "m").alias("model_name"), F.when(t == "view", "k").alias("kb_id"))
    return dedup.merge_model_duplicates(e).select(F.col("ord").alias("event_id"), F.col("wrapper_class").cast("long").alias("took"))


@query("""select o_orderkey as id, case when o_orderstatus = 'F' then 'other' else 'model' end as component_type, o_orderstatus <> 'F' and o_orderpriority <> '5-LOW' as needs_agentic from orders where o_orderstatus <> 'P'""")
def apply_verdicts(spark, d):
    o = _t(spark, d, "orders")
    c = o.select(F.col("o_orderkey").cast("string").alias("instance_id"), F.lit("model").alias("component_type"), F.lit(None).cast("double").alias("agentic_confidence"), F.lit(True).alias("needs_agentic"), F.lit("").alias("agentic_hint"))
    s = F.col("o_orderstatus")
    verdict = F.when(s == "P", "remove").when(s == "F", "reclassify").when(F.col("o_orderpriority") == "5-LOW", "keep")
    v = o.select(F.col("o_orderkey").cast("string").alias("instance_id"), verdict.alias("verdict"), F.lit("other").alias("new_type"), F.lit(0.9).alias("confidence"), F.col("o_orderkey").alias("ord")).where("verdict is not null")
    return agentic.apply_verdicts(c, v).select(F.col("instance_id").cast("long").alias("id"), "component_type", "needs_agentic")


@query(r"""with p as (select page_id, 'r' || (page_id % 3) as repo, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) as h from pages),
c as (select repo, h, min(page_id) as ord from p where page_id % 4 = 0 group by 1, 2),
k as (select 'https://' || h || '/a2a' as key, * from c union all select 'https://' || h, * from c),
q as (select page_id, repo, 1 as tier, 'https://' || h || case when page_id % 2 = 0 then '/a2a' else '/other' end as key from p union all select page_id, repo, 2, 'https://' || h from p),
m as (select page_id, q.repo, tier, k.repo as card_repo, h as card, ord from q join k using (key)), f as (select page_id, min(tier) as tier from m group by 1)
select page_id, arg_min(card, ord) as card, arg_min(card_repo, ord) as card_repo, m.tier from m join f using (page_id, tier) where repo <> card_repo group by page_id, m.tier""")
def agent_links(spark, d):
    p, k = _t(spark, d, "pages"), F.col("page_id")
    host, repo = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1)), F.concat(F.lit("r"), (k % 3).cast("string"))
    cards = p.where("page_id % 4 = 0").select(k, host.alias("name"), repo.alias("repo")).groupBy("name", "repo").agg(F.min("page_id").alias("ord")).withColumn("endpoints", F.array(F.concat(F.lit("HTTPS://"), F.upper("name"), F.lit("/a2a/"))))
    calls = p.select(k.alias("id"), repo.alias("repo"), F.concat(F.lit("https://"), host, F.when(k % 2 == 0, "/a2a?x=1").otherwise("/other")).alias("remote_url"))
    return links.agent_calls(calls, cards).select(F.col("id").alias("page_id"), "card", "card_repo", "tier")


def _modules():
    """Further queries, by subject."""
    from inventra import catalogue_calls, catalogue_flow, catalogue_names, catalogue_review, catalogue_scan  # noqa: F401
