"""Prompt states: applying actions, variants, evaluation and the step loop over all prompts at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions import text as T
from runloom.functions.payload import at
from runloom.functions.prompts import render_state, restore_contract, schema_strength
from runloom.operators.actions import action_headers, actions_from_issues, merge_actions, normalize_heads, stage_filter
from runloom.operators.history import (
    ACTION_BUDGET,
    MAX_CONSTRAINTS,
    MAX_PROMPT_GROWTH,
    NO_IMPROVE_ROUNDS,
    action_priority,
    cap_constraints,
    limit_actions,
    top_rows,
)
from runloom.operators.issues import analyze_single_output, issue_headers, measured_outputs
from runloom.operators.metrics import score_trial
from runloom.session import Parts, stored

# Targets that hold the answer format and are never changed, and the schema limit.
FORMAT_TARGETS = ("output_format", "response_schema", "response_contract")
SCHEMA_TIGHTEN_LIMIT = 2
MAX_STRICTNESS = 5
RULE_ACTIONS = ("add_checkpoint_rule", "modify_checkpoint_rule", "add_rule")
CONSTRAINT_ACTIONS = ("add_global_constraint", "add_constraint")
MAX_STEPS = 5
PART_LENGTH = 1 << 27  # characters of prompts that are moved at a time
MOST_PARTS = 8

Evaluator = Callable[[DataFrame], DataFrame]
VariantGenerator = Callable[[DataFrame], DataFrame]


# Applying actions --------------------------------------------------------------------------------


def enum_values(constraint: Column) -> Column:
    """VARIANT list of an ``enum: [..]`` constraint, NULL for any other text."""
    payload = T.strip(F.regexp_replace(constraint, r"(?s)^[^:]*:", ""))
    quoted = F.replace(payload, F.lit("'"), F.lit('"'))
    return F.when(F.lower(constraint).contains("enum") & constraint.contains(":"), F.try_parse_json(quoted))


def _object(value: Column) -> Column:
    empty = F.create_map().cast("map<string,variant>")
    return F.coalesce(F.try_variant_get(value, "$", "map<string,variant>"), empty)


def _put(entries: Column, key: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(entries, lambda k, _: k != key), F.create_map(key, value))


def _as_variant(entries: Column) -> Column:
    return F.try_parse_json(F.to_json(entries))


def schema_with_constraint(schema: Column, field: Column, constraint: Column) -> Column:
    """JSON schema with a constraint put on one field: its enum, else an addition to its description."""

    def changed_field(old: Column) -> Column:
        said = T.strip(F.coalesce(at(F.try_element_at(old, F.lit("description")), "$"), F.lit("")))
        longer = T.let(said, lambda d: F.when(d.contains(constraint), d).otherwise(T.strip(F.concat(d, F.lit(" "), constraint))))
        described = F.try_parse_json(F.concat(F.lit('"'), _escaped(longer), F.lit('"')))
        return T.let(
            enum_values(constraint),
            lambda enum: F.when(enum.isNotNull(), _put(old, F.lit("enum"), enum)).otherwise(_put(old, F.lit("description"), described)),
        )

    def changed_props(props: Column) -> Column:
        return _put(props, field, _as_variant(T.let(_object(F.try_element_at(props, field)), changed_field)))

    props = T.let(_object(F.try_variant_get(schema, "$.properties", "variant")), changed_props)
    return F.to_json(_put(_object(schema), F.lit("properties"), _as_variant(props)))


def _escaped(text: Column) -> Column:
    slashed = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.replace(F.replace(slashed, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))


def _is_json(text: Column) -> Column:
    return F.coalesce(~F.to_json(T.json_object(text)).isin("{}", "[]", "0", '""', "false", "null"), F.lit(False))


def _with_item(items: Column, item: Column) -> Column:
    return F.when(F.array_contains(items, item), items).otherwise(F.array_append(items, item))


def _with_rule(rules: Column, key: Column, value: Column) -> Column:
    entry = F.struct(key.alias("key"), value.alias("value"))
    known = F.exists(rules, lambda r: r["key"] == key)
    return F.when(known, F.transform(rules, lambda r: F.when(r["key"] == key, entry).otherwise(r))).otherwise(
        F.array_append(rules, entry)
    )


STATE_FIELDS = (
    "base_prompt", "role", "task", "schema", "checkpoint_rules", "strictness_level", "negative_examples", "global_constraints",
    "placeholders", "structured", "schema_frozen", "schema_tighten_count", "version", "contract",
)


def _tightened(state: Column, target: Column, content: Column) -> Column:
    """Schema after a tightening action, NULL when the action holds no schema."""
    on_field = T.let(
        T.json_object(state["schema"]),
        lambda now: F.when((target != "") & T.is_json_object(now), schema_with_constraint(now, target, content)),
    )
    return F.when(_is_json(content), content).otherwise(on_field)


def _applied(state: Column, action: Column, max_strictness: int, schema_limit: int) -> Column:
    """State after one action; actions on protected slots, or that add nothing, leave it as it is."""
    kind, target, content = action["type"], action["target"], action["content"]
    open_target = ~F.lower(target).isin(*FORMAT_TARGETS)
    usable = open_target & (content != "")
    rule = usable & kind.isin(*RULE_ACTIONS) & (target != "")
    plain = usable & kind.isin(*CONSTRAINT_ACTIONS)
    tighten = usable & (kind == "tighten_schema") & state["contract"].isNull() & ~state["schema_frozen"]
    stricter = open_target & (kind == "increase_strictness")

    def with_schema(new: Column) -> Column:
        spoken = tighten & new.isNull()
        stronger = tighten & new.isNotNull() & (schema_strength(new) >= schema_strength(state["schema"]))
        return F.struct(new.alias("schema"), spoken.alias("spoken"), stronger.alias("stronger"))

    def with_outcome(o: Column) -> Column:
        count = state["schema_tighten_count"] + o["stronger"].cast("int")
        level = F.least(F.lit(max_strictness), state["strictness_level"] + 1)
        changed = {
            "schema": F.when(o["stronger"], o["schema"]).otherwise(state["schema"]),
            "checkpoint_rules": F.when(rule, _with_rule(state["checkpoint_rules"], target, content)).otherwise(state["checkpoint_rules"]),
            "strictness_level": F.when(stricter, level).otherwise(state["strictness_level"]),
            "global_constraints": F.when(plain | o["spoken"], _with_item(state["global_constraints"], content)).otherwise(
                state["global_constraints"]
            ),
            "schema_frozen": state["schema_frozen"] | (o["stronger"] & (count >= schema_limit)),
            "schema_tighten_count": count,
        }
        return F.struct(*[changed.get(f, state[f]).alias(f) for f in STATE_FIELDS])

    new_schema = F.when(tighten, _tightened(state, target, content))
    return T.let(T.let(new_schema, with_schema), with_outcome)


def apply_actions(
    states: DataFrame,
    actions: DataFrame,
    key: str,
    budget: int | None = None,
    max_constraints: int | None = None,
    max_strictness: int = MAX_STRICTNESS,
    schema_limit: int = SCHEMA_TIGHTEN_LIMIT,
    normalize: bool = False,
) -> DataFrame:
    """Update the slots of every state by its actions, in order of priority and ``seq``.

    With ``normalize``, equal actions are merged first, by :func:`actions.normalize_actions`, from explicit rows or from heads with
    ``evidence_count``. With a ``budget`` only so many actions per state are taken (of merged ones those with most evidence), with
    ``max_constraints`` only the last so many constraints stay. Rows without actions still become a new, structured version.
    """
    if normalize:
        actions = normalize_heads(actions, key, budget)
    chosen = actions.select(key, "seq", "type", "target", "content")
    if budget is not None and not normalize:
        chosen = limit_actions(chosen, [key], budget)
    tidy = [T.strip(F.coalesce(c, F.lit(""))).alias(c) for c in ("type", "target", "content")]
    entry = F.struct(action_priority(F.col("type")).alias("prio"), "seq", *tidy)
    gathered = chosen.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_actions"))
    joined = states.join(gathered, key, "left")
    none = F.array().cast(gathered.schema["_actions"].dataType)
    folded = F.aggregate(
        F.coalesce("_actions", none), F.col("state"), lambda s, a: _applied(s, a, max_strictness, schema_limit)
    )
    constraints = F.col("state.global_constraints")
    done = joined.withColumn("state", folded).withColumn(
        "state",
        F.col("state")
        .withField("global_constraints", constraints if max_constraints is None else cap_constraints(constraints, max_constraints))
        .withField("version", F.col("state.version") + 1)
        .withField("structured", F.lit(True)),
    )
    return done.drop("_actions")


# Variants and evaluation -------------------------------------------------------------------------


def strictness_variants(states: DataFrame, count: int = 0) -> DataFrame:
    """The state as it is, one level stricter and one level laxer; ``count`` keeps only the first ones."""
    steps = (0, 1, -1)[: max(1, count)] if count > 0 else (0, 1, -1)
    exploded = states.select("*", F.posexplode(F.array(*map(F.lit, steps))).alias("variant_no", "_step"))
    level = F.greatest(F.lit(1), F.least(F.lit(MAX_STRICTNESS), F.col("state.strictness_level") + F.col("_step")))
    return exploded.withColumn("state", F.col("state").withField("strictness_level", level)).drop("_step")


def variant_states(states: DataFrame, count: int = 0, generate: VariantGenerator | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Variants of each state, numbered from 0 in ``variant_no``; ``count`` keeps only the first ones of each.

    ``generate`` makes them from ``states``: it returns their columns with other states, any number of rows for each, and
    ``variant_no``. ``keys`` identify a state and stay with its variants, so each can be traced to where it came from. A state
    that gets no variant is tried as it is. Without ``generate`` there are three, of different strictness.
    """
    if generate is None:
        return strictness_variants(states, count)
    made = generate(states).select(*states.columns, F.col("variant_no").cast("long").alias("variant_no"))
    if count > 0:
        made = top_rows(made, list(keys), [F.col("variant_no")], count)
    barren = states.join(made.select(*keys).distinct(), list(keys), "left_anti")
    return made.unionByName(barren.withColumn("variant_no", F.lit(0).cast("long")))


def state_prompt(state: Column) -> Column:
    return restore_contract(render_state(state), state["contract"])


def evaluation_dataset(samples: DataFrame, size: int | None = None) -> DataFrame:
    """The samples with a reference, or their own output in its place; with ``size`` only the first ones per workflow.

    ``samples`` has ``workflow_id, index, workflow_input, reference_text, output_text``.
    """
    reference = F.coalesce(F.nullif("reference_text", F.lit("")), "output_text")
    usable = samples.withColumn("reference", reference).where(T.non_empty(F.col("reference")))
    slim = usable.select("workflow_id", "workflow_input", "reference", F.col("index").alias("run_index"))
    return slim if size is None else top_rows(slim, ["workflow_id"], [F.col("run_index")], size)


def function_evaluator(fn: Callable[[pd.DataFrame], pd.DataFrame]) -> Evaluator:
    """Evaluator from a function on batches: adds ``output_text`` and ``status`` to the prompts it gets."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield fn(part)[["prompt_hash", "input_hash", "output_text", "status"]]

    def evaluate(prompts: DataFrame) -> DataFrame:
        return prompts.mapInPandas(batches, "prompt_hash string, input_hash string, output_text string, status string")

    return evaluate


def table_evaluator(outputs: DataFrame) -> Evaluator:
    """Evaluator from recorded outputs keyed by ``prompt_hash`` and ``input_hash``."""

    def evaluate(prompts: DataFrame) -> DataFrame:
        asked = prompts.select("prompt_hash", "input_hash")
        return asked.join(outputs.select("prompt_hash", "input_hash", "output_text", "status"), ["prompt_hash", "input_hash"])

    return evaluate


def _hashes(prompt: Column, workflow_input: Column) -> dict[str, Column]:
    return {"prompt_hash": T.prompt_hash(prompt), "input_hash": T.prompt_hash(F.coalesce(workflow_input, F.lit("")))}


def evaluate_candidates(candidates: DataFrame, evaluate: Evaluator) -> DataFrame:
    """Evaluate each distinct prompt and input once and give every candidate the result.

    ``candidates`` has ``prompt`` and ``workflow_input``; hashes, unless they are there, and results are added.
    """
    known = {"prompt_hash", "input_hash"} <= set(candidates.columns)
    hashed = candidates if known else candidates.withColumns(_hashes(F.col("prompt"), F.col("workflow_input")))
    once = hashed.groupBy("prompt_hash", "input_hash").agg(
        F.any_value("prompt").alias("prompt"), F.any_value("workflow_input").alias("workflow_input")
    )
    return hashed.join(evaluate(once), ["prompt_hash", "input_hash"], "left")


# The step loop -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class StepOptions:
    """Limits of the step loop; ``parts`` is the most parts in which texts are moved."""

    beam_width: int = 1
    variants: int = 0
    generate: VariantGenerator | None = None
    action_budget: int = ACTION_BUDGET
    max_growth: float = MAX_PROMPT_GROWTH
    no_improve_rounds: int = NO_IMPROVE_ROUNDS
    parts: int = MOST_PARTS


def start_nodes(prompts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Progress table and first beam of ``node_id, workflow_id, workflow_input, state``."""
    beam = prompts.select("node_id", F.lit(0).alias("beam_no"), "state")
    nodes = prompts.select(
        "node_id",
        "workflow_id",
        "workflow_input",
        F.lit("FORMAT").alias("stage"),
        F.lit(0).alias("clean_steps"),
        F.lit(float("-inf")).alias("best_score"),
        F.col("state").alias("best_state"),
        F.lit(0).alias("stale"),
        F.length(state_prompt(F.col("state"))).alias("first_length"),
        F.array().cast("array<string>").alias("seen"),
        F.lit(None).cast("string").alias("stop_reason"),
    )
    return nodes, beam


def _slot(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts))


def _candidates(started: DataFrame, options: StepOptions) -> tuple[DataFrame, Parts]:
    """Variants of the beam with what identifies them: a number ``row`` of their own, the trial, hashes and length of the prompt."""
    varied = variant_states(started, options.variants, options.generate, ["node_id", "beam_no"])
    tries = 3 if options.variants <= 0 else min(3, options.variants)
    if options.generate is not None:
        tries = 1 << 31  # a generator may yield any number
    said = T.let(state_prompt(F.col("state")), lambda p: F.struct(F.length(p).alias("prompt_length"), *(h.alias(n) for n, h in _hashes(p, F.col("workflow_input")).items())))
    numbered = varied.withColumn("seq", F.col("beam_no") * tries + F.col("variant_no")).withColumn("_p", said)
    kept = Parts(started.sparkSession, "step-candidates").add(
        numbered.select(
            F.monotonically_increasing_id().alias("row"), "node_id", "seq", F.concat_ws("#", F.col("node_id").cast("string"), F.col("seq").cast("string")).alias("trial_id"),
            "workflow_id", "workflow_input", "stage", "_p.*", "state",
        )
    )
    return kept.read(), kept


def _measured_trials(candidates: DataFrame, specs: DataFrame, evaluate: Evaluator, parts: int) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    """(trials, measured): the candidates with their answers' status, and what the answers' texts tell, all in narrow rows.

    Prompts are evaluated in parts by their hash, and a part's answers go when they are measured, so that the disk holds the
    texts of one part at a time. A prompt lies in one part and is evaluated once.
    """
    spark, told = candidates.sparkSession, candidates.drop("state", "workflow_input").columns
    trials, scores, hits = (Parts(spark, f"step-{name}") for name in ("trials", "scores", "hits"))
    for i in range(parts):
        asked = candidates.where(_slot("prompt_hash", parts) == i).withColumn("prompt", state_prompt(F.col("state")))
        answers = Parts(spark, "step-answers").add(evaluate_candidates(asked, evaluate).select(*told, "output_text", "status"))
        answered = answers.read()
        trials.add(answered.drop("output_text").withColumn("duration_seconds", F.lit(0.0)))
        for store, found in zip((scores, hits), measured_outputs(answered, candidates, specs)):
            store.add(found)
        answers.drop()
    return trials.read(), (scores.read(), hits.read())


def _judge_trials(
    trials: DataFrame, specs: DataFrame, options: StepOptions, measured: tuple[DataFrame, DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Trials with their counts and score, and the limited actions per trial."""
    issues = stored(analyze_single_output(trials, specs, measured=measured), "step-issues")
    per_trial = trials.select("trial_id", "workflow_id").join(specs, "workflow_id").drop("workflow_id")
    normalized = stored(actions_from_issues(issues, per_trial, "trial_id"), "step-normalized")
    staged = normalized.join(trials.select("trial_id", "stage"), "trial_id")
    merged = stored(merge_actions(stage_filter(staged, F.col("stage")).drop("stage"), "trial_id"), "step-merged")
    actions = stored(limit_actions(action_headers(merged, "trial_id"), ["trial_id"], options.action_budget), "step-actions")
    low = F.lower("message")
    found = issue_headers(issues, "trial_id").groupBy("trial_id").agg(
        F.count(F.lit(1)).alias("_issues"),
        F.bool_or(low.contains("format") | low.contains("json") | low.contains("schema")).alias("_format"),
    )
    planned = actions.groupBy("trial_id").agg(F.count(F.lit(1)).alias("_actions"))
    zero = F.lit(0).cast("long")
    counted = trials.join(found, "trial_id", "left").join(planned, "trial_id", "left")
    scored = counted.withColumns(
        {
            "issue_count": F.coalesce("_issues", zero),
            "action_count": F.coalesce("_actions", zero),
            "has_format_issue": F.coalesce("_format", F.lit(False)),
        }
    ).drop("_issues", "_actions", "_format")
    return scored.withColumn("score", score_trial(F.col("issue_count"), F.col("action_count"))), actions


def _moved(going: DataFrame, best: DataFrame, states: DataFrame, options: StepOptions) -> DataFrame:
    """Nodes moved on by their best trial, with its score and counts; ``states`` holds the states of trials by ``row``."""
    joined = going.join(best, "node_id")
    clean = ~F.col("b.has_format_issue")
    looped = F.array_contains("seen", F.col("b.prompt_hash"))
    grown = F.col("b.prompt_length") > F.floor(F.col("first_length") * options.max_growth)
    quiet = looped | grown
    better = ~quiet & (F.col("b.score") > F.col("best_score"))
    stale = F.when(quiet, F.col("stale")).when(better, 0).otherwise(F.col("stale") + 1)
    recall_clean = F.when((F.col("stage") == "RECALL") & clean, F.col("clean_steps") + 1).otherwise(0)
    stage = (
        F.when((F.col("stage") == "FORMAT") & clean, "RECALL")
        .when((F.col("stage") == "RECALL") & (recall_clean >= 2), "STRICT")
        .otherwise(F.col("stage"))
    )
    reason = (
        F.when(looped, "loop")
        .when(grown, "growth")
        .when(F.col("b.issue_count") == 0, "no_issues")
        .when(F.col("b.action_count") == 0, "no_actions")
        .when(stale >= options.no_improve_rounds, "plateau")
    )
    moved = joined.select(
        "node_id",
        "workflow_id",
        "workflow_input",
        stage.alias("stage"),
        F.when(recall_clean >= 2, 0).otherwise(recall_clean).alias("clean_steps"),
        F.when(better, F.col("b.score")).otherwise(F.col("best_score")).alias("best_score"),
        "best_state",
        stale.alias("stale"),
        "first_length",
        F.when(looped, F.col("seen")).otherwise(F.array_append("seen", F.col("b.prompt_hash"))).alias("seen"),
        reason.alias("stop_reason"),
        F.when(better, F.col("b.row")).alias("_better"),
        F.col("b.score").alias("score"),
        F.col("b.issue_count").alias("issue_count"),
        F.col("b.action_count").alias("action_count"),
    )
    changed = moved.join(states.select(F.col("row").alias("_better"), "state"), "_better", "left")
    return changed.withColumn("best_state", F.when(F.col("_better").isNotNull(), F.col("state")).otherwise(F.col("best_state"))).drop("_better", "state")


def optimize_step(
    nodes: DataFrame, beam: DataFrame, specs: DataFrame, evaluate: Evaluator, step: int, options: StepOptions = StepOptions()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Advance every prompt that has not stopped by one step: ``(nodes, beam, timeline)``.

    Variants of the beam are rendered, evaluated once per distinct prompt, checked and scored. The best
    one moves the stage on and decides whether the prompt stops; otherwise the beam's actions are applied.
    Both tables are stored, so plans do not grow with the steps.

    Texts lie in the candidates only, and trials, issues and actions refer to them by numbers. Where texts are moved, to be
    evaluated and into the new tables, they go in parts, by prompt and by node, of which each frees its disk for the next.
    """
    spark = nodes.sparkSession
    going = nodes.where(F.col("stop_reason").isNull())
    started = beam.join(going.select("node_id", "workflow_id", "workflow_input", "stage"), "node_id")
    candidates, texts = _candidates(started, options)
    length = candidates.agg(F.sum("prompt_length")).first()[0] or 0
    parts = min(options.parts, 1 + length // PART_LENGTH)
    trials, measured = _measured_trials(candidates, specs, evaluate, parts)
    scored, actions = _judge_trials(trials, specs, options, measured)
    kept = stored(top_rows(scored, ["node_id"], [F.col("score").desc(), F.col("seq")], max(1, options.beam_width)), "step-kept")
    best = kept.groupBy("node_id").agg(
        F.max_by(
            F.struct("row", "prompt_hash", "prompt_length", "issue_count", "action_count", "has_format_issue", "score"),
            F.struct(F.col("score"), -F.col("seq")),
        ).alias("b")
    )
    actions = stored(actions.join(kept.select("trial_id", "node_id").distinct(), "trial_id"), "step-kept-actions")

    def part(rows: DataFrame, i: int) -> DataFrame:
        return rows.where(_slot("node_id", parts) == i)

    # from here on only the states of kept trials are needed
    states = [Parts(spark, "step-states").add(part(candidates, i).select("row", "state").join(part(kept, i).select("row"), "row", "left_semi")) for i in range(parts)]
    texts.drop()
    next_nodes = Parts(spark, "step-nodes")
    for i, known in enumerate(states):
        moved = _moved(part(going, i), part(best, i), known.read(), options).withColumn("_moved", F.lit(True))
        stopped = part(nodes.where(F.col("stop_reason").isNotNull()), i)
        next_nodes.add(moved.unionByName(stopped, allowMissingColumns=True))
    every = next_nodes.read()
    timeline = every.where("_moved").select("node_id", F.lit(step).alias("step"), "stage", "score", "issue_count", "action_count", "stop_reason")
    going_on = every.where(F.col("_moved") & F.col("stop_reason").isNull()).select("node_id")
    next_beam = Parts(spark, "step-beam")
    for i, known in enumerate(states):
        chosen = _beam_numbers(part(kept, i).join(part(going_on, i), "node_id", "left_semi"))
        planned = part(actions, i).drop("node_id")
        survivors = chosen.join(known.read(), "row").drop("row")
        acting = survivors.join(planned.select("trial_id").distinct(), "trial_id", "left_semi")
        acted = apply_actions(acting, planned, "trial_id", options.action_budget, MAX_CONSTRAINTS)
        # only the first of the beam advances without actions; a further candidate without any stays as it is
        plain = survivors.join(planned.select("trial_id").distinct(), "trial_id", "left_anti")
        held = part(beam, i).join(part(going_on, i), "node_id", "left_anti")
        next_beam.add(held.unionByName(acted.unionByName(plain).drop("trial_id")))
        known.drop()
    return every.select(*nodes.columns), next_beam.read(), timeline


def _beam_numbers(survivors: DataFrame) -> DataFrame:
    """Number the beam of each node by score; a beam holds at most ``beam_width`` rows."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("node_id").orderBy(F.col("score").desc(), F.col("seq"))
    return survivors.select("node_id", (F.row_number().over(order) - 1).alias("beam_no"), "trial_id", "row")


def optimize_prompts(
    prompts: DataFrame, specs: DataFrame, evaluate: Evaluator, max_steps: int = MAX_STEPS, options: StepOptions = StepOptions()
) -> tuple[DataFrame, DataFrame]:
    """Run the steps: final state per node with its stop reason, and the timeline of all steps.

    The driver only counts steps; each step is a job over all prompts. A loop, too much growth or a
    plateau rolls back to the best state.
    """
    nodes, beam = start_nodes(prompts)
    nodes, beam = stored(nodes, "step-nodes"), stored(beam, "step-beam")
    timeline = None
    for step in range(max_steps):
        nodes, beam, rows = optimize_step(nodes, beam, specs, evaluate, step, options)
        timeline = rows if timeline is None else timeline.unionByName(rows)
    current = beam.where(F.col("beam_no") == 0).select("node_id", "state")
    rolled = F.col("stop_reason").isin("loop", "growth", "plateau")
    final = nodes.join(current, "node_id").select(
        "node_id", "workflow_id", "stage", "stop_reason", "best_score",
        F.when(F.coalesce(rolled, F.lit(False)), F.col("best_state")).otherwise(F.col("state")).alias("state"),
    )
    return final, timeline
