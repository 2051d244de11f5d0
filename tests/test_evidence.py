"""Signatures met with classes: what matches, where, and what a user changes."""

import re

import pytest

from inventra.operators import evidence as E
from inventra.tables import stored

#: name: (source, {(class, kind, signature): (first line, last line)})
CASES = {
    "call": ("from langchain.agents import AgentExecutor\nclass R:\n    def f(self):\n        g()\n        self.a = AgentExecutor(x)\n        AgentExecutor.from_agent_and_tools(y)\n", {("R", "framework", "langchain.AgentExecutor"): (5, 5)}),
    "assigned": ("import langchain.agents as la\nclass R:\n    def f(self):\n        self.a = la.AgentExecutor(x)\n", {("R", "framework", "langchain.AgentExecutor"): (4, 4)}),
    "not_imported": ("class R:\n    def f(self):\n        self.a = AgentExecutor(x)\n", {}),
    "base": ("from langchain.agents import BaseSingleActionAgent as B\nclass R(B, X):\n    pass\n", {("R", "framework", "langchain.BaseSingleActionAgent"): (2, 2)}),
    "other_end": ("from autogen import x\nclass R:\n    a = agents.AssistantAgent()\n", {("R", "framework", "autogen.AssistantAgent"): (3, 3)}),
    "two_frameworks": ("import crewai, strands\nclass R:\n    def f(self):\n        return Agent(1)\n", {("R", "framework", "crewai.Agent"): (4, 4), ("R", "framework", "strands.Agent"): (4, 4)}),
    "module_level": ("import crewai\na = crewai.Agent()\nclass R:\n    pass\n", {}),
    "protocol_text": ("class R:\n    card = '/.well-known/agent.json'\n    def f(self):\n        return 'message/send'\n", {("R", "protocol", "a2a.server"): (2, 2), ("R", "protocol", "a2a.client"): (4, 4)}),
    "name_before_text": ("class R:\n    card = 'tools/call'\n    def f(self):\n        return ClientSession(1)\n", {("R", "protocol", "mcp.client"): (4, 4)}),
    "text_of_the_inner": ("class R:\n    class S:\n        def f(self):\n            return 'tasks/get'\n", {("S", "protocol", "a2a.client"): (4, 4)}),
    "not_protocol_text": ("class R:\n    def f(self):\n        return 'see message/send now', 'x' * 9\n", {}),
    "loop": ("class R:\n    def f(self):\n        for i in r(1):\n            a.chat.completions.create()\n            b() if c else d()\n", {("R", "react_loop", "structural.react_loop"): (3, 5)}),
    "loop_without_branch": ("class R:\n    def f(self):\n        while True:\n            llm.invoke()\n            b()\n            c()\n", {}),
    "loop_without_model": ("class R:\n    def f(self):\n        while True:\n            a.run()\n            if b(): c()\n", {}),
    "loop_with_two_callees": ("class R:\n    def f(self):\n        while done(1):\n            llm.invoke()\n            if x: b()\n            b()\n", {}),
    "calls_of_a_nested_function": ("class R:\n    def f(self):\n        while True:\n            def g():\n                llm.invoke()\n            if b(): c()\n", {}),
    "nested_loops": ("class R:\n    async def f(self):\n        async for x in y:\n            while z:\n                llm.ainvoke()\n                if b(): c()\n", {("R", "react_loop", "structural.react_loop"): (3, 6)}),
    "decorated_class": ("from temporalio import workflow\n\n@workflow.defn\nclass W:\n    pass\n", {("W", "anti", "temporal.workflow"): (4, 4)}),
    "decorated_method": ("from fastapi import APIRouter\nrouter = APIRouter()\nclass W:\n    @router.get('/')\n    def f(self): pass\n", {("W", "anti", "fastapi.endpoint"): (4, 4)}),
    "model": ("from pydantic import BaseModel\nclass W(BaseModel):\n    x: int\n", {("W", "anti", "pydantic.basemodel"): (2, 2)}),
    "model_by_name_alone": ("from mine import BaseModel\nclass W(BaseModel):\n    x: int\n", {}),
    "remote": ("import boto3\nclass A:\n    class B:\n        def f(self):\n            self.c.invoke_agent(x)\n", {("B", "remote", "aws.bedrock_agents"): (5, 5)}),
    "remote_of_another": ("import boto3\nclass A:\n    def f(self):\n        self.c.invoke_model(x)\n", {}),
    "broken": ("class A(:\n", {}),
}


@pytest.fixture(scope="module")
def facts(spark):
    files = spark.createDataFrame([("r", f"{name}.py", text) for name, (text, _) in CASES.items()], "root string, path string, content string")
    return E.facts(files.repartition(3)).cache()


def test_every_case(facts):
    got = {}
    for r in E.matches(facts).collect():
        got.setdefault(r.path[:-3], []).append(((r.class_name, r.kind, r.signature), (r.start_line, r.end_line)))
    want = {name: sorted(w.items()) for name, (_, w) in CASES.items() if w}
    want["nested_loops"] = sorted([*want["nested_loops"], (("R", "react_loop", "structural.react_loop"), (4, 6))])
    assert {name: sorted(rows) for name, rows in got.items()} == want


def test_dossiers(facts):
    got = {(r.path[:-3], r.class_name): (r.preferred, r.direct, r.proxy, r.excluded) for r in E.dossiers(facts).collect()}
    assert got[("base", "R")] == ("framework_inheritance", True, False, False) and got[("protocol_text", "R")] == ("a2a_server", True, True, False)
    assert got[("name_before_text", "R")] == ("other", False, False, False) and got[("model", "W")] == (None, False, False, True)
    assert got[("text_of_the_inner", "R")] == (None, False, False, False) and got[("loop", "R")] == ("react_loop", True, False, False)
    assert {r.path for r in E.agents(E.dossiers(facts)).collect()} == {f"{n}.py" for n in ("call", "assigned", "base", "other_end", "two_frameworks", "protocol_text", "loop", "nested_loops")}


def test_a_users_signatures(facts):
    """One of a known id takes its place, others come after, unfit ones are left out."""
    user = {
        "frameworks": [{"id": "mine", "evidence_pattern": "framework_agent", "entrypoint_qualified_names": "llm.invoke"}, {"id": "no_pattern"}, "x", {"id": "crewai.Agent", "evidence_pattern": "framework_agent", "entrypoint_qualified_names": ["Nothing"]}],
        "anti_patterns": [{"id": "looped", "label": "looped", "base_class_names": ["B"]}], "remote_agent_sdks": [{"id": "no_suffix"}], "protocols": None, "verification_policy": {"min_react_loop_distinct_callees": 2, "other": 1},
    }
    assert E.merged(user)["frameworks"]["crewai.Agent"]["entrypoint_qualified_names"] == ["Nothing"] and len(E.merged(user)["frameworks"]) == len(E.FRAMEWORKS) + 1 and "no_suffix" not in E.merged(user)["remote_agent_sdks"]
    rows = E.matches(facts, user).collect()
    got = {(r.path[:-3], r.kind, r.signature) for r in rows}
    assert ("loop_without_branch", "framework", "mine") in got and ("loop_with_two_callees", "react_loop", "structural.react_loop") in got
    assert not any(r.signature == "crewai.Agent" for r in rows) and E.merged("x") == E.merged(None) and E.policy("x") == E.POLICY


def test_nothing(spark):
    f = E.facts(spark.createDataFrame([], "root string, path string, content string"))
    assert E.matches(f).collect() == [] and E.dossiers(f).collect() == []


def test_dossiers_broadcast_needles_alone(spark):
    """Classes, calls and imports grow with the files: only signatures may go through the driver."""
    f = stored(E.facts(spark.createDataFrame([("r", "a.py", "from crewai import Agent\nclass A:\n    def f(self): Agent()\n")], "root string, path string, content string")))
    plan = E.dossiers(f)._jdf.queryExecution().executedPlan().toString()
    sent = re.findall(r"BroadcastHashJoin \[(\w+)#", plan)
    assert sent and set(sent) <= {"_s", "name"} and "BroadcastNestedLoopJoin" not in plan


def test_all_rules_share_one_join_with_classes(spark):
    """The driver holds the plan and each stage's metrics: one join of points with spans for all rules, one for the innermost class, one for imports."""
    f = stored(E.facts(spark.createDataFrame([("r", "a.py", "from crewai import Agent\nclass A:\n    def f(self): Agent()\n")], "root string, path string, content string")))
    for made in (E.matches(f), E.dossiers(f)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") <= 3
