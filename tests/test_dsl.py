from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from runloom.operators import dsl as D


def trees(spark, *values):
    rows = [(i, json.dumps(v) if not isinstance(v, str) else v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id long, t string").withColumn("tree", F.try_parse_json("t"))


def located(spark, tree):
    nodes = D.dsl_nodes(trees(spark, tree), ["id"], "tree")
    return [(r.node_id, r.path, r.text) for r in D.prompt_locations(nodes, ["id"]).orderBy("bucket_no", "node_no", "message_no").collect()]


def test_nested_graph_and_system_prompt(spark):
    tree = {"workflow": {"graph": {"nodes": [{"id": 5, "data": {"prompt_template": {"messages": [{"text": "a"}, {"role": "x"}, 3]}, "system_prompt": "s"}}]}}}
    assert located(spark, tree) == [
        ("5", "/workflow/graph/nodes/0/data/prompt_template/messages/0/text", "a"),
        ("5", "/workflow/graph/nodes/0/data/system_prompt", "s"),
    ]


@pytest.mark.parametrize("tree", ["not json", [], {"graph": []}, {"graph": {"nodes": []}}, {"graph": {"nodes": [1, {"id": "x"}]}}])
def test_trees_without_prompts(spark, tree):
    assert located(spark, tree) == []


def test_pointer_lookup(spark):
    tree = trees(spark, {"graph": {"nodes": [{"a": "x"}, {"a": None, "b.c": 7}]}})
    got = [
        tree.select(D.pointer_lookup(F.col("tree"), F.lit(p))).first()[0]
        for p in ("/graph/nodes/0/a", "/graph/nodes/1/b.c", "/graph/nodes/1/a", "/graph/nodes/2/a", "/nope/0", "graph")
    ]
    assert got == ["x", "7", None, None, None, None]


def test_last_patch_wins_and_old_texts_stay(spark):
    leaves = spark.createDataFrame([(1, "/a", "old"), (1, "/b", "keep")], "id long, path string, text string")
    patches = spark.createDataFrame([(1, "/a", 1, "one"), (1, "/a", 2, "two"), (1, "/new", 1, "n"), (1, "bad", 1, "x")], "id long, path string, patch_no int, new string")
    got = {(r.path, r.text, r.patched) for r in D.apply_patches(leaves, patches, ["id"]).collect()}
    assert got == {("/a", "two", True), ("/b", "keep", False), ("/new", "n", True)}


def test_primary_message(spark):
    nodes = D.dsl_nodes(
        trees(spark, {"graph": {"nodes": [{"id": "a", "data": {"prompt_template": [{"role": "user", "text": "u"}, {"role": "System", "text": "s"}]}}, {"id": "b", "data": {"prompt_template": [{"text": "only"}]}}]}}),
        ["id"], "tree",
    )
    blocks = D.prompt_blocks(nodes, ["id"])
    got = {r.node_id: r.t for r in blocks.select("node_id", D.primary_message(F.col("messages"))["text"].alias("t")).collect()}
    assert got == {"a": "s", "b": "only"}


def set_pointer(tree, path, value):
    """A plain version, for one pointer."""
    steps = [s for s in path.split("/") if s]
    here = tree
    for n, step in enumerate(steps):
        if isinstance(here, list):
            step = int(step)
            here.extend({} for _ in range(step + 1 - len(here)))
        if n + 1 == len(steps):
            here[step] = value
        else:
            inside = here[step] if isinstance(here, list) else here.get(step)
            if not isinstance(inside, (dict, list)):
                here[step] = {}
            here = here[step]


def by_position(path):
    return [(0, int(s), "") if s.isdigit() else (1, 0, s) for s in path.split("/") if s]


LONG = {"list": [{"n": i, "deep": {"text": f"t{i}", "flag": True, "none": None}} for i in range(13)], "x": {"y.z": "q", "it's": [1, [2, 3]], 'a"b': 1.5}, "empty": [], "s": "text"}
CASES = [
    {}, {"/list/11/deep/text": "new"}, {"/list/2/n": "two", "/list/10/n": "ten", "/list/9/deep": "flat"}, {"/list/15/a/b": "grown"},
    {"/x/y.z": "dot", "/x/it's/1/0": "quoted", '/x/a"b': "é \n \"q\""}, {"/new/0/text": "object", "/empty/1": "second"}, {"/x": "gone", "/x/back/again": "here"},
    {"//s//t": "in", "no pointer": "ignored"}, {"/list": "all gone"}, {"/list/0": "", "/list/0/n/m": "below"},
]


def test_patched_trees_equal_a_plain_version(spark):
    frame = trees(spark, *[LONG] * len(CASES))
    rows = [(i, p, n, v) for i, case in enumerate(CASES) for n, (p, v) in enumerate(case.items())]
    rows += [(i, p, -1, "an earlier patch") for i, case in enumerate(CASES) for p in case]
    patches = spark.createDataFrame(rows, "id long, path string, patch_no int, new string")
    got = {r.id: (json.loads(r.p), json.loads(r.t)) for r in D.patch_trees(frame, patches, ["id"], "tree").select("id", F.to_json("patched").alias("p"), "t").collect()}
    for i, case in enumerate(CASES):
        want = json.loads(json.dumps(LONG))
        for path in sorted(case, key=by_position):
            if path.startswith("/"):
                set_pointer(want, path, case[path])
        assert got[i] == (want, LONG), case


def test_patches_that_cannot_be_applied_give_no_tree(spark):
    frame = trees(spark, *[LONG] * 3, "not json", {"a": 1})
    rows = [(0, "/list/first/n", 1, "x"), (1, "/", 1, "x"), (2, "/list/0/n", 1, "fine"), (3, "/a/b", 1, "x"), (4, "/a", 1, None), (9, "/a", 1, "no tree")]
    patches = spark.createDataFrame(rows, "id long, path string, patch_no int, new string")
    got = {r.id: r.p for r in D.patch_trees(frame, patches, ["id"], "tree").select("id", F.to_json("patched").alias("p")).collect()}
    assert got[0] is None and got[1] is None and json.loads(got[2])["list"][0]["n"] == "fine"
    assert json.loads(got[3]) == {"a": {"b": "x"}} and len(got) == 5
    assert D.patch_trees(frame, patches.limit(0), ["id"], "tree").where("patched is null").count() == 1


def test_a_patched_tree_is_dealt_out_once_and_rows_that_share_their_keys_are_patched_each(spark):
    frame = trees(spark, LONG, {"s": "other"}).withColumn("id", F.lit(1).cast("long"))
    patches = spark.createDataFrame([(1, "/s", 1, "one"), (1, "/s", 2, "two"), (1, "/new/0/text", 1, "x")], "id long, path string, patch_no int, new string")
    done = D.patch_trees(frame, patches, ["id"], "tree").select(F.to_json("patched").alias("p"))
    got = sorted((json.loads(r.p) for r in done.collect()), key=len)
    new = {"s": "two", "new": {"0": {"text": "x"}}}
    assert got == [new, LONG | new]
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("Aggregate ") == 1 and "Generate" not in plan
