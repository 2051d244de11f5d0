"""The inventory's operators on small relations."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from inventra import catalogue
from inventra.fixtures import files
from inventra.functions import text as X
from inventra.operators import agentic, compare, dedup, derive, extract, graph, joins, links
from inventra.operators import search
from inventra.plans import assess
from inventra.sinks import reports
from inventra.sources import files as S
from inventra.tables import stored


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("f", "given", "want"), [
    (X.canonical_url, "HTTPS://User:p@Ex.com:443/a/b/?q#f", "https://ex.com/a/b"), (X.canonical_url, "http://ex.com:8080/.well-known/agent.json", "http://ex.com:8080"), (X.canonical_url, "http://ex.com/x/.well-known/agent-card.json", "http://ex.com/x"),
    (X.canonical_url, "http://ex.com/", "http://ex.com/"), (X.canonical_url, "ftp://x/y", None), (X.canonical_url, None, None),
    (X.canonical_git, "git@GitHub.com:Org/Repo.git", "github.com/Org/Repo"), (X.canonical_git, "https://tok@github.com:443/Org/Repo.git/", "github.com/Org/Repo"), (X.canonical_git, "", None), (X.canonical_git, "github.com:org/repo", "github.com/org/repo"), (X.canonical_git, "Bare.host", "bare.host"),
    (X.canonical_image, "python:3.12@sha256:ab", "docker.io/library/python"), (X.canonical_image, "GHCR.io/a/b:1", "ghcr.io/a/b"), (X.canonical_image, "a/b", "docker.io/a/b"),
    (X.is_model_pinned, "gpt-4o-2024", True), (X.is_model_pinned, "gpt-4o", False), (X.is_model_pinned, None, False), (X.is_model_pinned, "org/m", True), (X.is_model_pinned, "gpt-3.5turbo", True), (X.is_model_pinned, "m==abc", True), (X.is_model_pinned, "llama@latest", True),
    (X.is_test_path, "a/tests/b.py", True), (X.is_test_path, "a/spec/b.py", False), (X.is_test_path, "a/b_test.py", True), (X.is_test_path, "Test_x.py", True), (X.is_test_path, None, False),
    (X.requirement_name, "LangChain_Core[all]>=1 ; x", "langchain-core"), (X.requirement_pin, "a === 1.0 # c", "1.0"), (X.requirement_pin, "a>=1", None),
    (X.class_segment, "a.Beta.c", "Beta"), (X.bedrock_base, "us.anthropic.claude-3-haiku-v1:0", "claude-3-haiku"), (X.bedrock_base, "gpt-4", None),
    (X.in_skipped_dir, "a/node_modules/b.js", True), (X.in_skipped_dir, "a/build", False), (X.in_skipped_dir, "x.egg-info/y", True), (X.in_skipped_dir, "deploy/env/prod.yaml", False), (X.in_skipped_dir, "a/site-packages/b", True),
])
def test_functions(spark, f, given, want):
    assert one(spark, f(F.lit(given).cast("string"))) == want


def test_model_aliases(spark):
    assert one(spark, X.model_aliases(F.lit("Azure/ft:openai.gpt-4:1"))) == ["azure/ft:openai.gpt-4:1", "ft:openai.gpt-4:1", "openai.gpt-4:1", "gpt-4:1", "gpt-4"]
    assert one(spark, X.model_aliases(F.lit("us.anthropic.claude-3-5-sonnet-20241022-v2:0")))[1:] == ["anthropic.claude-3-5-sonnet-20241022-v2:0", "claude-3-5-sonnet-20241022-v2:0", "claude-3-5-sonnet-20241022-v2", "claude-3-5-sonnet"]


def test_merge_is_greedy_and_one_to_one(spark):
    kb, code = "kb_enrichment", "code_analysis"
    rows = [("f", 10, 1, "m1", code, "m", None, ""), ("f", 12, 2, "Chat", kb, None, "k1", "fw"), ("f", 13, 3, "n1", code, "n", None, "own"), ("f", 14, 4, "Two", kb, None, "k2", ""), ("f", 40, 5, "Far", kb, None, "k3", ""), ("g", 10, 6, "z", code, "z", None, "")]
    df = spark.createDataFrame([("model", *r) for r in rows] + [("tool", "f", 11, 7, "t", kb, None, "k9", "")], "component_type string, file_path string, line_number int, ord int, name string, detection_source string, model_name string, kb_id string, framework string")
    got = {r.ord: (r.kb_id, r.wrapper_class, r.framework) for r in dedup.merge_model_duplicates(df).collect()}
    assert got == {1: ("k1", "Chat", "fw"), 3: ("k2", "Two", "own"), 5: ("k3", None, ""), 6: (None, None, ""), 7: ("k9", None, "")}


def test_sources_are_numbered(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "s string, o int")
    assert {r.label for r in dedup.numbered_sources(df, "s", "o").collect()} == {"a", "a#2", "b"}


def test_substitution_keeps_unknown(spark):
    env = spark.createDataFrame([("A", "1", "dotenv", "p", 1), ("A", "2", "dotenv", "q", 2)], "name string, value string, source_type string, source_path string, ord int")
    df = spark.createDataFrame([("x${A}-${B}y", 1), ("plain", 2)], "v string, k int")
    assert {r.k: r.v for r in joins.substitute(df, "v", env).collect()} == {1: "x1-${B}y", 2: "plain"}


def test_removal_takes_the_least_restrictive(spark):
    shape = "ord int, key string, weak boolean, test boolean, local boolean, protected boolean, file_path string"
    c = spark.createDataFrame([(1, "a", False, False, False, False, "x"), (2, "a", True, False, False, False, "x"), (3, "b", True, True, False, False, "x"), (4, "c", False, False, True, False, "x"), (5, "c", False, False, True, False, "y"), (6, "b", False, False, False, True, "x")], shape)
    gone = spark.createDataFrame([(0, "a", True, False, False, False, "x"), (0, "b", False, False, False, False, "x"), (0, "c", False, False, True, False, "y")], shape)
    assert sorted(r.ord for r in joins.cascade_removals(c, gone).collect()) == [1, 4, 6]


def test_custom_catalogue_has_lowest_precedence(spark):
    k = spark.createDataFrame([("a.B", "x"), ("c.B", "parameter")], "id string, label string")
    custom = spark.createDataFrame([("a.B", "custom"), ("z.q.B", "custom"), ("z.Q", "custom")], "id string, label string")
    s = spark.createDataFrame([("B",), ("y.Q",)], "symbol string")
    assert sorted(tuple(r) for r in joins.catalogue_lookup(k, s, custom=custom).collect()) == [("a.B", "x"), ("z.q.B", "custom")]
    new = spark.createDataFrame([("a.B", "n", 1), ("d", "second", 2), ("d", "first", 1)], "id string, label string, ord int")
    assert sorted(tuple(r) for r in joins.merged_catalogue(k, new).collect()) == [("a.B", "x"), ("c.B", "parameter"), ("d", "first")]


def test_diff_takes_the_last_duplicate(spark):
    shape = "name string, type string, v int, ord int"
    old = spark.createDataFrame([("a", "t", 1, 1), ("a", "t", 2, 2), ("b", "t", None, 3)], shape)
    new = spark.createDataFrame([("a", "t", 2, 1), ("b", "t", 5, 1), ("c", "t", 1, 1)], shape)
    got = {r.name: (r.change, r.fields) for r in compare.diff(old, new, ["name", "type"], ["v"]).collect()}
    assert got == {"a": ("same", ""), "b": ("changed", "v"), "c": ("added", "")}


def test_call_graph_ends_in_cycles(spark):
    calls = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("a", "a")], "caller string, callee string")
    got = graph.callers_within(calls, spark.createDataFrame([("b",)], "name string"))
    assert {(r.caller, r.distance) for r in got.collect()} == {("a", 1), ("c", 2)}


def test_image_values_are_never_kept(spark):
    env = spark.createDataFrame([("A", "1", "dotenv", "p", 5)], "name string, value string, source_type string, source_path string, ord long")
    got = links.image_env(env, spark.createDataFrame([("K", "img", "secret")], "name string, image string, value string")).where("name = 'K'").first()
    assert got.value == "" and got.ord > 5


def test_evidence(spark):
    f = spark.createDataFrame([("p", "a\nfoo  bar\nb\nb")], "path string, content string")
    cited = spark.createDataFrame([(1, "p", "foo bar", 2, 2), (2, "p", "foo bar", 4, 4), (3, "p", "b", 9, 9), (4, "q", "x", 1, 1), (5, "p", "bar\nb b", 1, 1), (6, "p", " ", 1, 1)], "id int, path string, snippet string, start_line int, end_line int")
    got = {r.id: (r.status, r.line, r.last_line) for r in agentic.verified_evidence(cited, f).collect()}
    assert got == {1: ("verified", 2, 2), 2: ("repaired", 2, 2), 3: ("rejected", None, None), 4: ("rejected", None, None), 5: ("repaired", 2, 4), 6: ("rejected", None, None)}


def test_policy_shapes(spark):
    assert assess.load_policy({"no_hardcoded_keys": True, "fail_on": "HIGH", "max_risk_score": "7"}) == ([("no_hardcoded_keys", {}, "critical"), ("max_risk_score", {"threshold": 7}, "high")], "high")
    assert assess.load_policy({"rules": [{"rule": "max_risk_score", "params": {"threshold": 1}, "severity": "low"}], "no_hardcoded_keys": True})[0] == [("max_risk_score", {"threshold": 1}, "low")]
    for bad in ({"rules": [{"rule": "max_risk_score", "severity": "odd"}]}, {"blocked_models": "x"}, {"fail_on": "never"}):
        with pytest.raises(ValueError):
            assess.load_policy(bad)
    c = spark.createDataFrame([("m", "model", " ", False), ("n", "model", "gpt-4", False), ("llm", "tool", None, True)], "name string, component_type string, model_name string, needs_agentic boolean")
    rules, fail_on = assess.load_policy({"require_pinned_models": True, "blocked_models": ["LLM"], "require_guardrail_for": ["model", "tool", "agent"], "max_unresolved_agentic": 0})
    found = assess.policy_violations(c, rules)
    assert sorted((r.rule, r.subject) for r in found.collect()) == [("max_unresolved_agentic", "unresolved"), ("require_guardrail_for", "model"), ("require_guardrail_for", "tool"), ("require_pinned_models", "m"), ("require_pinned_models", "n")]
    assert not assess.policy_passes(found, fail_on) and assess.policy_passes(found, "critical")


def test_compliance_coverage(spark):
    checks = spark.createDataFrame([("eu-1", "pass"), ("eu-2", "fail"), ("eu-3", "not_applicable"), ("nist-1", "not_applicable")], "requirement string, status string")
    assert {r.framework: r.coverage for r in assess.coverage(checks).collect()} == {"eu": 50.0, "nist": 100.0}


def test_scanners(spark):
    got = {(r.root, r.path, r.name, r.component_type) for r in extract.scan(files(spark)).collect()}
    want = {
        ("agents", "requirements.txt", "openai", "dependency"), ("agents", "requirements.txt", "langchain", "dependency"), ("agents", "app/agent.py", "gpt-4o", "model"), ("agents", ".env", "gpt-4o", "model"), ("agents", "app/agent.py", "gpt-4o-2024-08-06", "model"),
        ("agents", "app/agent.py", "env:OPENAI_API_KEY", "secret"), ("agents", "web/app.ts", "openai", "dependency"), ("agents", "app/agent.py", "helper", "agent"), ("agents", "app/agent.py", "lookup", "tool"),
        ("agents", "app/agent.py", "Loop", "agent"), ("agents", "app/agent.py", "crewai", "dependency"), ("agents", "n.ipynb", "claude-3-5-sonnet", "model"), ("agents", "mcp.json", "web", "mcp_server"),
        ("agents", ".claude/skills/review/SKILL.md", "review", "skill"), ("agents", "infra/main.tf", "scorer", "model_endpoint"), ("agents", "cfg.py", "api_key", "secret"),
        ("remote", "card/.well-known/agent.json", "Remote", "agent"), ("remote", "flow.json", "LM", "model"), ("remote", "data/a.csv", "a.csv", "dataset"),
    }
    assert want <= got
    names = {n for _, _, n, _ in got}
    assert not names & {"flask", "commented-1.0", "in-a-docstring", "b.csv", "numpy", "Set"}
    assert not any("sk-abc" in n or "https://secret" in n for n in names)


def test_env_and_manifests(spark):
    env = {(r.name, r.value) for r in S.env_index(files(spark)).collect()}
    assert {("OPENAI_API_KEY", "x"), ("AGENT_URL", "https://agents.example.com/a2a"), ("MODEL", "gpt-4o")} <= env and "NO" not in {n for n, _ in env}
    assert {(r.name, r.pin) for r in S.manifests(files(spark)).collect()} >= {("openai", "1.2.3"), ("flask", None), ("crewai", "0.5")}
    assert [(r.name, r.escapes_root) for r in S.local_dependencies(files(spark)).collect()] == [("lib", True)]


def test_read_tree(spark, tmp_path):
    for path in ("a/x.py", "node_modules/y.js", "docs/z.md"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x = 1")
    got = S.read_tree(spark, [str(tmp_path)], ["docs/"])
    assert [(r.path, r.content) for r in got.collect()] == [("a/x.py", "x = 1")]


def test_search(spark):
    own = files(spark)
    assert [r.line for r in search.search_codebase(own, "chatopenai\\(").collect()] == [6]
    assert {(r.path, r.value) for r in search.definitions(own, "MODEL").collect()} == {(".env", "gpt-4o")}
    with pytest.raises(ValueError, match="ambiguous"):
        search.by_prefix(spark.createDataFrame([("ab",), ("ac",)], "id string"), "a")


def test_reports(spark):
    c = spark.createDataFrame([("s", "n|m", "agent", "a.py", 3, "", "code", 0.5, None, None, None, "i1", 1, False, True), ("s", "k", "secret", "b.py", 1, "", "code", 0.9, None, None, "d", "i2", 2, True, True)],
        "source string, name string, component_type string, file_path string, line_number int, framework string, detection_source string, heuristic_confidence double, agentic_confidence double, model_name string, description string, instance_id string, ord long, test_only boolean, needs_agentic boolean")
    flags = assess.weighted(spark.createDataFrame([("hardcoded_api_key", "b.py", 1, "i2")], "flag string, file_path string, line_number int, instance_id string"))
    for name, render in reports.REPORTERS.items():
        assert render(c, flags=flags), name
    assert json.loads(reports.REPORTERS["sarif"](c, flags=flags))["runs"][0]["results"][-1]["level"] == "warning"
    assert json.loads(reports.REPORTERS["cyclonedx"](c))["vulnerabilities"][0]["id"] == "asset-secret-i2"
    junit = reports.REPORTERS["junit"](c, flags=flags)
    assert 'tests="2" failures="1"' in junit and "component_i2" not in junit and "n\\|m" in reports.REPORTERS["markdown"](c)
    assert reports.totals(c).first().asDict() == {"sources": 1, "components": 1, "test_only": 1, "pending": 2}
    assert [r.name for r in reports.component_summary(c).collect()] == ["n|m"]
    assert [r.name for r in reports.api_components(c, "agent", "a.*").collect()] == ["n|m"]
    assert [r.component_type for r in reports.api_types(c).collect()] == ["agent", "secret"]


def test_searches(spark):
    f = spark.createDataFrame([("a.py", "x = os.getenv('MODEL')\nx = 'lit'\nclass A:\n  pass\n", 10)], "path string, content string, length long")
    assert [(r.line, r.context) for r in search.search_text(f, r"CLASS A:\n\s+pass").collect()] == [(3, "class A:")]
    assert [(r.line, r.literal, r.env) for r in search.data_flow(f, "a.py", "x").collect()] == [(1, None, "MODEL"), (2, "lit", None)]
    assert [r.entry for r in search.directory_tree(files(spark).where("root = 'remote'"), 1).collect()][:2] == ["card", "data"]
    assert search.snippet(f, "a.py", 1).first().snippet == "x = os.getenv('MODEL')"


def test_batches_run_over_directories(spark):
    c = spark.createDataFrame([(i, f"d{i // 3}") for i in range(8)], "ord int, dir string")
    got = {r.ord: r.batch for r in agentic.batches(c, 2, "dir", ["ord"]).collect()}
    assert got == {i: i // 2 for i in range(8)}


def test_watch(spark, tmp_path):
    from inventra.streaming.watch import misses, read_changes, watch

    shape, told = "root string, path string, content string, mtime long", []
    (tmp_path / "in").mkdir()

    def run(n, rows):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("root", "path", "content", "mtime"), r, strict=True))) for r in rows))
        q = watch(read_changes(spark, str(tmp_path / "in"), shape), str(tmp_path / "state"), extract.SCANNERS["model"], lambda df, k: told.append(sorted((r.name, r.change) for r in df.collect())), str(tmp_path / "check"))
        q.awaitTermination()

    run(0, [("r", "a.py", "model = 'gpt-4o'", 1)])
    run(1, [("r", "a.py", "model = 'gpt-5x'", 2)])
    assert told == [[("gpt-4o", "added")], [("gpt-4o", "removed"), ("gpt-5x", "added")]]
    repos = spark.createDataFrame([("p", "s1"), ("q", None)], "path string, sha string")
    known = repos.where("path = 'p'").select(X.short_hash(F.col("path"), 24).alias("key"), "sha")
    assert [r.path for r in misses(repos, known).collect()] == ["q"]


def test_every_oracle_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    assert Row


def test_entry_without_a_session():
    """The entry module names its queries and their SQL before Spark is started."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert o and set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], check=True, timeout=120)


def test_merge_deals_files_out(spark):
    """A file with very many rows is merged by the lines near each row, and files aren't put into one task."""
    rows = [("model", "kb_enrichment" if i % 2 else "code_analysis", "k" if i % 2 else "", f"k{i}" if i % 2 else f"n{i}", "" if i % 2 else "m", "big.py", i // 2, "", i) for i in range(20_000)]
    df = spark.createDataFrame(rows, "component_type string, detection_source string, kb_id string, name string, model_name string, file_path string, line_number int, framework string, ord long")
    out = dedup.merge_model_duplicates(df)
    assert {r.ord: r.wrapper_class for r in out.collect()} == {i: f"k{i + 1}" for i in range(0, 20_000, 2)}
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()


def test_files_wire_their_agents_without_wide_rows(spark):
    """The list of a file's tools isn't shuffled by agent; repeated ids stay apart."""
    kind = "instance_id string, name string, category string, file_path string, assigned_target string, arguments map<string,string>, ord long, wired boolean"
    rows = [("a", "a", "Agent", "f", "", {"x": "y"}, 1, True), ("a", "b", "Agent", "g", "", {"x": "y"}, 2, False), ("t", "t1", "tool", "f", "v", {}, 3, False), ("u", "t2", "tool", "f", "", {}, 4, False), ("c", "c", "Agent", None, "", {}, 5, True)]
    out = derive.same_file_arguments(spark.createDataFrame(rows, kind))
    assert sorted((r.name, r.arguments) for r in out.collect()) == [("a", {"x": "y", "tools": "LIST:VARIABLE:v,VARIABLE:t2"}), ("b", {"x": "y"}), ("c", {}), ("t1", {}), ("t2", {})]


def test_parsed_rows_are_spread_and_not_broadcast(spark):
    """A small packed table of many files: read over all tasks, never sent to the driver."""
    found = S.parsed(spark.createDataFrame([("r", f"{i}.py", "x") for i in range(40)], "root string, path string, content string").coalesce(1), lambda root, path, content: iter([(content,)]), "name string")
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = spark.range(5).withColumn("root", F.lit("r")).join(found, "root")._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=merge)" in plan
    assert "strategy=merge" in stored(spark.range(3))._jdf.queryExecution().analyzed().toString() or "ResolvedHint" in stored(spark.range(3))._jdf.queryExecution().analyzed().toString()


def test_includes_are_found_once(spark):
    """What a round of includes finds is stored: no round's joins are run again by the next."""
    tree = [("r", "requirements.txt", "-r a.in\n"), ("r", "a.in", "-r b.in\nx\n"), ("r", "b.in", "-r a.in\ny\n")]
    out = S.included_requirements(spark.createDataFrame(tree, "root string, path string, content string"))
    assert sorted(r.path for r in out.collect()) == ["a.in", "b.in"]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_catalogue_assets_parse_files_once(spark):
    """What code does is stored: no branch of the plan parses files again."""
    k = spark.createDataFrame([("crewai.Agent", "agent", "class", "crewai")], "id string, concept string, label string, framework string")
    files = spark.createDataFrame([("r", "a.py", "import crewai\nlead = crewai.Agent(name='n')\n")], "root string, path string, content string")
    found = extract.catalogue_assets(files, k)
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
