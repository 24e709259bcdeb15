from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from runloom.operators import expand as X

PARAMS = "dataset string, ordinal int, param string, values array<string>, min long, max long, step long, default string, pairwise boolean"


def dims_of(spark, levels, name="d"):
    rows = [(name, i, f"p{i}", [f"{i}.{j}" for j in range(n)], None, None, None, None, True) for i, n in enumerate(levels)]
    return X.dimensions(spark.createDataFrame([(name,)], "dataset string"), spark.createDataFrame(rows, PARAMS))


@pytest.mark.parametrize(
    "low,high,step,expected", [(1, 10, 4, [1, 5, 9, 13]), (1, 3, None, [1, 2, 3]), (10, 1, -2, [10, 8, 6, 4, 2, 0]), (5, 1, 1, []), (1, 9, 0, [])]
)
def test_ranges(spark, low, high, step, expected):
    df = spark.createDataFrame([([], low, high, step, None)], "v array<string>, a long, b long, s long, d string")
    got = df.select(X.expand_parameter(F.col("v"), F.col("a"), F.col("b"), F.col("s"), F.col("d"))).first()[0]
    assert got == [str(x) for x in expected]
    if step != 0:
        assert expected == list(range(low, high + (step or 1), step or 1))


def test_strict_range_and_default(spark):
    df = spark.createDataFrame([(None, 1, 10, 4, None), (None, None, None, None, "x")], "v array<string>, a long, b long, s long, d string")
    cols = [F.col(c) for c in "vabsd"]
    assert [r[0] for r in df.select(X.expand_parameter(*cols, strict_max=True)).collect()] == [["1", "5", "9"], ["x"]]


@pytest.mark.parametrize("levels,cap", [([2, 3, 4], 1000), ([3, 3], 5), ([50, 40, 30], 1500), ([2, 0, 2], 10), ([], 10)])
def test_cartesian_is_a_prefix_of_the_product(spark, levels, cap):
    if levels:
        dims = dims_of(spark, levels)
    else:
        dims = X.dimensions(spark.createDataFrame([("d",)], "dataset string"), spark.createDataFrame([], PARAMS))
    got = [r.parameters for r in X.cases_cartesian(dims, cap).orderBy("case_no").collect()]
    lists = [[f"{i}.{j}" for j in range(n)] for i, n in enumerate(levels)]
    names = [f"p{i}" for i in range(len(levels))]
    wanted = [dict(zip(names, combo)) for combo in itertools.islice(itertools.product(*lists), cap)]
    assert got == wanted


def test_pairwise_covers_every_pair(spark):
    rng = random.Random(11)
    shapes = [[rng.randint(1, 6) for _ in range(rng.randint(2, 10))] for _ in range(12)] + [[4, 4], [5] * 10, [2] * 10]
    frames = None
    for i, levels in enumerate(shapes):
        one = dims_of(spark, levels, f"d{i}")
        frames = one if frames is None else frames.unionByName(one)
    cases = X.cases_pairwise(frames).cache()
    shown = {}
    for r in cases.collect():
        shown.setdefault(r.dataset, []).append(r.parameters)
    for i, levels in enumerate(shapes):
        rows = shown[f"d{i}"]
        for a, b in itertools.combinations(range(len(levels)), 2):
            seen = {(r[f"p{a}"], r[f"p{b}"]) for r in rows}
            assert len(seen) == levels[a] * levels[b], (levels, a, b)
    assert X.pairwise_coverage(frames, cases).count() == 0
    assert len(shown[f"d{len(shapes) - 3}"]) == 16


def test_pairwise_of_one_dimension(spark):
    assert X.cases_pairwise(dims_of(spark, [3])).count() == 3


def test_coverage_reports_missing_pairs(spark):
    dims = dims_of(spark, [2, 2])
    cases = X.cases_pairwise(dims)
    assert X.pairwise_coverage(dims, cases.where("case_no > 0")).count() > 0


def test_limit_is_repeatable_and_a_subset(spark):
    cases = X.cases_cartesian(dims_of(spark, [5, 5]))
    first = {r.case_no for r in X.limit_cases(cases, ["dataset"], 7, seed=3).collect()}
    again = {r.case_no for r in X.limit_cases(cases, ["dataset"], 7, seed=3).collect()}
    assert first == again and len(first) == 7
    assert {r.case_no for r in X.limit_cases(cases, ["dataset"], 4).collect()} == {0, 1, 2, 3}


def test_broadcast_inputs(spark):
    rows = [("w", "a", True, ["1", "2"]), ("w", "b", False, ["x"]), ("w", "c", True, ["3", "4"]),
            ("bad", "a", True, ["1"]), ("bad", "b", True, ["1", "2"]), ("flat", "q", False, ["s"]), ("none", "a", True, [])]
    df = spark.createDataFrame(rows, "workflow_id string, name string, is_list boolean, values array<string>")
    got = {(r.workflow_id, r["index"]): r.inputs for r in X.broadcast_inputs(df).collect()}
    assert got == {("w", 1): {"a": "1", "b": "x", "c": "3"}, ("w", 2): {"a": "2", "b": "x", "c": "4"}, ("flat", 1): {"q": "s"}}


def test_align_references(spark):
    runs = spark.createDataFrame([(w, i) for w in ("one", "many", "none") for i in (1, 2, 3)], "workflow_id string, index long")
    refs = spark.createDataFrame([("one", 1, "r"), ("many", 1, "a"), ("many", 2, None)], "workflow_id string, index long, reference_text string")
    got = {(r.workflow_id, r["index"]): r.reference_text for r in X.align_references(runs, refs).collect()}
    assert got == {("one", 1): "r", ("one", 2): "r", ("one", 3): "r", ("many", 1): "a", ("many", 2): None}


def test_modes_of_generate_cases(spark):
    plan = spark.createDataFrame([("w", True, ["d", "f", "gone"], ["v1", "v2"]), ("off", False, ["d"], None)], "catalog_id string, enabled boolean, dataset_refs array<string>, variants array<string>")
    datasets = spark.createDataFrame([("d", "normal"), ("f", "normal")], "dataset string, scenario string")
    params = spark.createDataFrame([("d", 0, "a", ["1", "2"], None, None, None, None, True), ("d", 1, "b", ["x", "y"], None, None, None, None, True), ("d", 2, "c", ["z", "u"], None, None, None, None, False)], PARAMS)
    flows = spark.createDataFrame([("f", 0, "hi")], "dataset string, flow_no int, title string")
    sizes = {m: X.generate_cases(plan, datasets, params, flows, m).count() for m in ("scenario_only", "pairwise", "cartesian")}
    assert sizes == {"scenario_only": 2 * (1 + 1), "pairwise": 2 * (4 + 1), "cartesian": 2 * (8 + 1)}
    with pytest.raises(ValueError):
        X.generate_cases(plan, datasets, params, flows, "other")
    made = X.generate_cases(plan, datasets, params, flows)
    ids = [r.task_id for r in X.build_tasks(made).collect()]
    assert len(ids) == len(set(ids)) == 10
    assert sorted(ids) == sorted(r.task_id for r in X.build_tasks(made).collect())


def test_kinds_of_generated_cases(spark):
    plan = spark.createDataFrame([("w", True, ["d", "e", "f"], None)], "catalog_id string, enabled boolean, dataset_refs array<string>, variants array<string>")
    datasets = spark.createDataFrame([("d", "s1"), ("e", "s2"), ("f", None)], "dataset string, scenario string")
    rows = [("d", 0, "a", ["1", "2"], None, None, None, None, True), ("e", 0, "a", ["7", "8"], None, None, None, None, False), ("e", 1, "b", [], None, None, None, None, True), ("f", 0, "a", ["5", "6"], None, None, None, None, True)]
    flows = spark.createDataFrame([("f", 0, "hi"), ("f", 1, None), ("g", 0, "no such dataset")], "dataset string, flow_no int, title string")
    got = X.generate_cases(plan, datasets, spark.createDataFrame(rows, PARAMS), flows).collect()
    assert sorted((r.dataset, r.case_no, str(r.scenario), str(sorted(r.parameters.items())), str(r.flow)) for r in got) == [
        ("d", 0, "s1", "[('a', '1')]", "None"), ("d", 1, "s1", "[('a', '2')]", "None"), ("e", 0, "s2", "[('a', '7'), ('b', None)]", "None"),
        ("f", 0, "None", "[('a', '5')]", "hi"), ("f", 1, "None", "[('a', '5')]", "None"),
    ]


def test_template_variables_are_literal(spark):
    df = spark.createDataFrame([("Hi {{ a.b }} {{c}} {{ d }}", {"a.b": "$1\\x", "c": "{{ d }}"})], "t string, v map<string,string>")
    assert df.select(X.render_template(F.col("t"), F.col("v"))).first()[0] == "Hi $1\\x {{ d }} {{ d }}"


def test_twelve_dimensions_lose_no_pair(spark):
    dims = dims_of(spark, [2, 3] * 6)
    paired = X.pairwise_dims(dims)
    assert X.pairwise_coverage(paired, X.cases_pairwise(paired)).count() == 0


def test_products_have_no_cap_but_the_named_one(spark):
    dims = dims_of(spark, [12, 11, 10])
    assert X.cases_cartesian(dims).count() == 1320
    assert [(r.total, r.left_out) for r in X.cases_left_out(dims, 1000).collect()] == [(1320, 320)]
    huge = dims_of(spark, [50] * 12)
    last = X.cases_cartesian(huge, 3).orderBy("case_no").collect()
    assert [r.case_no for r in last] == [0, 1, 2] and len({str(r.parameters) for r in last}) == 3
    with pytest.raises(Exception, match="more cases than can be numbered"):
        X.cases_cartesian(huge).collect()
