from __future__ import annotations

import difflib
import random

import pytest
from pyspark.sql import functions as F

from runloom.functions import prompts as P
from runloom.functions import text as T
from runloom.operators import texts as X


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("x")).first().x


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "文字", "é"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 90))) for _ in range(25)]
    rows = [(i, rng.choice(texts), rng.choice(texts)) for i in range(120)] + [(200, "", ""), (201, "abc", "")]
    return spark.createDataFrame(rows, "id long, a string, b string").repartition(5).cache()


def test_similarity_by_brute_force(pairs):
    for r in X.with_similarity(pairs, "a", "b").collect():
        assert r.similarity == pytest.approx(difflib.SequenceMatcher(None, r.a, r.b).ratio())


def test_soft_match_by_brute_force(pairs):
    rows = X.soft_reference_match(pairs, "a", "b").collect()
    assert len(rows) == 122
    for r in rows:
        wanted = bool(r.a and r.b) and difflib.SequenceMatcher(None, r.a, r.b).ratio() >= 0.55
        assert r.matches == wanted


def test_placeholders_in_order(spark):
    text = "${b} {{ x }} {{y.z}} {{ x }} ${a}"
    assert one(spark, text, T.placeholders) == ["{{ x }}", "{{y.z}}", "${b}", "${a}"]
    assert one(spark, None, T.placeholders) == []


def test_mask_and_restore(spark):
    text = "Use {{a}} and ${b} and {{a}}"
    masked = one(spark, text, lambda c: T.mask_placeholders(c, T.placeholders(c)))
    assert masked == "Use <<<PH_0>>> and <<<PH_1>>> and <<<PH_0>>>"
    assert one(spark, text, lambda c: T.restore_placeholders(T.mask_placeholders(c, T.placeholders(c)), T.placeholders(c))) == text


@pytest.mark.parametrize(
    "text,wanted",
    [
        ("ROLE:\nA\nTASK:\nB\nC\n", {"role": "A", "task": "B\nC"}),
        ("intro\nrole:\nA\nROLE :\nlater", {"role": "later"}),
        ("ROLE:\nTASK:\nB", {"task": "B"}),
        ("ROLE:\nA\nROLE:\n", {}),
        ("JSON SCHEMA:\n{}\nOutput Json Schema:\n[]", {"schema": "[]"}),
        ("ROLE:\n\n", {"role": ""}),
        ("Not a header: x\nUNKNOWN:\n", {}),
        ("ROLE:\r\nA\r\nB\r\n", {"role": "A\nB"}),
    ],
)
def test_sections(spark, text, wanted):
    df = P.with_sections(spark.createDataFrame([(text,)], "t string"), "t")
    assert df.first().sections == wanted


def test_negative_examples(spark):
    text = "Reason: lost\n- Wrong: a\nmore\nReason: r1\nReason: r2\nwrong: b\n\n- Wrong:"
    got = [(r.bad_output, r.reason) for r in one(spark, text, P.negative_examples)]
    assert got == [("a\nmore", "r2"), ("b", None), ("", None)]
    assert [(r.bad_output, r.reason) for r in one(spark, "plain\nReason: why", P.negative_examples)] == [("plain", "why")]


@pytest.mark.parametrize(
    "text,schema",
    [
        ("x\nOUTPUT JSON SCHEMA:\n{\"a\":1}\n", '{"a":1}'),
        ("JSON SCHEMA:\n  {\"a\":1}\nNEXT:\ny", '{"a":1}'),
        ("JSON SCHEMA:\n{\"a\":1}\nNEXT:\ny", None),  # the first unindented line already starts a section that ends in a colon
        ("OUTPUT FORMAT:\n\n", None),
        ("has {{RESPONSE_CONTRACT}}\nJSON SCHEMA:\n{}", None),
        ("", None),
    ],
)
def test_contract_round_trip(spark, text, schema):
    row = one(spark, text, P.extract_contract)
    assert row.schema == schema
    if schema is None:
        assert row.text == text
    else:
        assert "{{RESPONSE_CONTRACT}}" in row.text
        back = spark.createDataFrame([(row.text, row.schema)], "t string, s string").select(P.restore_contract(F.col("t"), F.col("s"))).first()[0]
        assert schema in back and "{{RESPONSE_CONTRACT}}" not in back


def test_blocks_keep_their_numbers(spark):
    blocks = one(spark, "one\n\n\n\nSee output\n\n示例 x", P.text_blocks)
    assert [(b.block_id, b.kind) for b in blocks] == [("b0", "instruction"), ("b2", "output"), ("b3", "example")]
    assert [b.text for b in one(spark, " \n\n ", P.text_blocks)] == [" \n\n "]


def test_messages_survive_a_round_trip_in_parts(spark):
    rows = [(1, i, "user" if i % 2 else "system", f"text {i}\nline") for i in range(25)]
    df = spark.createDataFrame(rows, "node_id long, index long, role string, text string")
    merged = X.merge_messages(df, ["node_id"], part_messages=10)
    assert merged.count() == 3
    back = {r["index"]: (r.role, r.text) for r in X.split_messages(merged, ["node_id"], "merged_text").collect()}
    assert back == {i: (role, text) for _, i, role, text in rows}


@pytest.mark.parametrize(
    "raw,passed,severity,fmt",
    [
        ('{"verdict":"pass"}', True, None, True),
        ('{"verdict":"pass","format_ok":null}', False, "medium", False),
        ('{"verdict":"pass","missing_items":["a"],"format_ok":false}', False, "high", False),
        ('{"verdict":"pass","incorrect_items":["a"]}', False, "high", True),
        ("it will pass", True, None, True),
        ("PASS or fail", False, "high", False),
        ("[1]", False, "high", False),
    ],
)
def test_judge_answers(spark, raw, passed, severity, fmt):
    row = X.parse_judge_verdict(spark.createDataFrame([(raw,), (None,)], "raw string"), "raw").collect()
    assert len(row) == 1
    assert (row[0].passed, row[0].severity, row[0].format_ok) == (passed, severity, fmt)


def test_intent(spark):
    rows = [("nothing alike", ["return json"], False), ("return json now", ["return json"], False), ("zzz yyy", ["a b"], False), ("--", ["return json"], True), ("far off words", ["one two three four five six seven eight"], True)]
    for prompt, constraints, skipped in rows[1:]:
        df = spark.createDataFrame([(prompt, constraints, [])], "p string, c array<string>, e array<string>")
        assert df.select(X.skip_for_intent(F.col("p"), F.col("c"), F.col("e"))).first()[0] is skipped, prompt


def plain_coverage(samples, constraints):
    return {c: sum(c.lower() in (t or "").lower() for t in samples) for c in dict.fromkeys(constraints) if c}


def test_constraints_are_found_through_their_index(spark):
    rng = random.Random(12)
    words = ["".join(rng.choices("aeioubcdlmnrst", k=rng.randrange(3, 10))) for _ in range(40_000)]
    constraints = [f"Mention {rng.choice(words)} and {rng.choice(words)}" for _ in range(9980)]
    constraints += ["a", "é", "𝒳𝒴", "Ende", "x𝒳y𝒴z", "", None, "the end", "İstanbul", "abc\ndef"] + ["the end"] * 10
    texts = [" ".join(rng.choices(words, k=300)) + " " + rng.choice(constraints[:9980]).upper() for _ in range(40)]
    texts += [None, "", "THE END\nabc\nDEF", "x𝒳Y𝒴z 𝒳𝒴 İSTANBUL", "é"]
    samples = spark.createDataFrame([("w", i, t) for i, t in enumerate(texts)] + [("few", 0, "has a and B"), ("none", 0, "x")], "workflow_id string, index long, output_text string")
    specs = spark.createDataFrame([("w", constraints), ("few", ["A", "b", "c"]), ("idle", ["a"]), ("none", [])], "workflow_id string, constraints array<string>")
    found = X.constraint_coverage(samples, specs).collect()
    assert {r.constraint: r.found for r in found if r.workflow_id == "w"} == plain_coverage(texts, constraints)
    assert {r.runs for r in found if r.workflow_id == "w"} == {len(texts)}
    assert {(r.workflow_id, r.constraint, r.runs, r.found) for r in found if r.workflow_id != "w"} == {("few", "A", 1, 1), ("few", "b", 1, 1), ("few", "c", 1, 0)}
    looked = X.constraint_candidates(samples, specs).where("workflow_id = 'w'").agg(F.sum(F.size("_items"))).first()[0]
    assert looked < 0.01 * len(texts) * len(constraints)


BLOCK = "<ROLE::system::0>\nYou {{x}}\n</ROLE::system::0>\n<ROLE::user::1>\nask\n</ROLE::user::1>"


@pytest.mark.parametrize("rewritten, want", [
    ("[[ROLE_MARKER_0]]\nWe <<<PH_0>>>\n[[ROLE_MARKER_1]]\n[[ROLE_MARKER_2]]\nbeg\n[[ROLE_MARKER_3]]", BLOCK.replace("You", "We").replace("ask", "beg")),
    ("[[ROLE_MARKER_0]] <<<PH_0>>> [[ROLE_MARKER_1]] [[ROLE_MARKER_2]]", BLOCK),  # a lost marker
    ("[[ROLE_MARKER_0]] [[ROLE_MARKER_1]] [[ROLE_MARKER_2]] [[ROLE_MARKER_3]]", BLOCK),  # a lost placeholder
    # a doubled marker is there, so it is taken as it stands
    ("[[ROLE_MARKER_0]][[ROLE_MARKER_0]]<<<PH_0>>>[[ROLE_MARKER_1]][[ROLE_MARKER_2]][[ROLE_MARKER_3]]",
     "<ROLE::system::0><ROLE::system::0>{{x}}</ROLE::system::0><ROLE::user::1></ROLE::user::1>"),
    (None, BLOCK), ("", BLOCK),
])
def test_rewrites_keep_their_role_markers(spark, rewritten, want):
    rows = spark.createDataFrame([(BLOCK, rewritten)], "t string, r string")
    assert X.guard_rewrite(rows, "t", "r").first().guarded == want


def test_many_markers_are_masked_by_position(spark):
    text = "".join(f"<ROLE::user::1>{i}" for i in range(25)) + "[[ROLE_MARKER_99]]"
    masked = one(spark, text, T.mask_role_markers)
    assert masked == "".join(f"[[ROLE_MARKER_{i}]]{i}" for i in range(25)) + "[[ROLE_MARKER_99]]"
    back = one(spark, text, lambda t: T.restore_role_markers(T.mask_role_markers(t), T.role_markers(t)))
    assert back == text and one(spark, "", T.mask_role_markers) == "" and one(spark, None, T.mask_role_markers) is None


def test_context_lines(spark):
    read = lambda text: tuple(one(spark, text, T.workflow_context))
    assert read("Workflow Name: a b \n Workflow Description:c: d\nWorkflow Name: last") == ("last", "c: d")
    assert read("Workflow Name:\nname: x") == ("", None) and read("") == (None, None)


@pytest.mark.parametrize("answer, want", [("Yes.", True), ("NO", False), ("yes and no", None), ("I do not know", False), ("maybe", None), (None, None)])
def test_yes_or_no(spark, answer, want):
    assert one(spark, answer, lambda t: T.yes_or_no(F.coalesce(t, F.lit("")), F.lit(None).cast("boolean"))) is want
