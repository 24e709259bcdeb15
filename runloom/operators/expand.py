"""Expanding plans into test cases, manifests and tasks.

Every generator computes a case from its number, so nothing beyond a cap is ever produced and no product
is materialised. A dataset's parameters are gathered into one array because every case row holds one
value of each of them anyway.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runloom.functions.text import draw_order
from runloom.operators.ordering import with_position
from runloom.session import checkpointed

HIERARCHICAL_DIMS = 5  # fixed value: dimensions that the hierarchical mode pairs
_BLOCK = 1000
_MOST = (1 << 63) - 1


# Inputs and references ---------------------------------------------------------------------------


def broadcast_inputs(inputs: DataFrame) -> DataFrame:
    """One row per workflow and position: scalars repeated, lists zipped.

    ``inputs`` has ``workflow_id, name, is_list, values`` (a scalar is a one-element array). Workflows
    whose lists differ in length are left out; ``validate_input_multiplicity`` reports them.
    """
    size = F.when(F.col("is_list"), F.size("values"))
    shape = inputs.groupBy("workflow_id").agg(F.min(size).alias("_low"), F.max(size).alias("_high"))
    sound = shape.where(F.coalesce(F.col("_low") == F.col("_high"), F.lit(True)))
    scalars = (
        inputs.where(~F.col("is_list"))
        .groupBy("workflow_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("name", F.element_at("values", 1)))).alias("_scalars"))
    )
    zipped = (
        inputs.where("is_list")
        .select("workflow_id", "name", F.posexplode("values").alias("_i", "_value"))
        .groupBy("workflow_id", (F.col("_i") + 1).cast("long").alias("_index"))
        .agg(F.map_from_entries(F.collect_list(F.struct("name", "_value"))).alias("_row"))
    )
    empty = F.create_map().cast("map<string,string>")
    return (
        sound.join(scalars, "workflow_id", "left")
        .join(zipped, "workflow_id", "left")
        .where((F.coalesce("_high", F.lit(1)) > 0))
        .select(
            "workflow_id",
            F.coalesce("_index", F.lit(1).cast("long")).alias("index"),
            F.map_concat(F.coalesce("_scalars", empty), F.coalesce("_row", empty)).alias("inputs"),
        )
    )


#: Why a run has no reference text.
NO_REFERENCE, SURPLUS, MISSING = "workflow has no reference", "beyond the last reference", "reference is missing"


def labelled_alignment(runs: DataFrame, references: DataFrame) -> DataFrame:
    """Every run with its ``reference_text`` or, in ``reason``, why it has none.

    ``runs`` has ``workflow_id, index``; ``references`` has ``workflow_id, index, reference_text``. One reference serves every
    run of its workflow, otherwise run *i* is paired with reference *i*.
    """
    shape = references.groupBy("workflow_id").agg(
        F.max("index").alias("_n"), F.min_by("reference_text", "index").alias("_only")
    )
    numbered = references.select("workflow_id", "index", F.col("reference_text").alias("_own"))
    paired = runs.join(shape, "workflow_id", "left").join(numbered, ["workflow_id", "index"], "left")
    text = F.when(F.col("_n") == 1, F.col("_only")).otherwise(F.col("_own"))
    reason = (
        F.when(F.col("_n").isNull(), NO_REFERENCE)
        .when((F.col("_n") > 1) & (F.col("index") > F.col("_n")), SURPLUS)
        .when(text.isNull(), MISSING)
    )
    return paired.withColumns({"reference_text": text, "reason": reason}).drop("_n", "_only", "_own")


def align_references(runs: DataFrame, references: DataFrame) -> DataFrame:
    """Runs within the references of their workflow, with ``reference_text``, NULL where the reference is missing.

    The others, and why, are in :func:`labelled_alignment`.
    """
    inside = F.col("reason").isNull() | (F.col("reason") == MISSING)
    return labelled_alignment(runs, references).where(inside).drop("reason")


# Plan joins --------------------------------------------------------------------------------------


def plan_dataset_join(plan: DataFrame, datasets: DataFrame) -> DataFrame:
    """Plan workflows with their datasets; references to unknown datasets drop out."""
    refs = plan.select("catalog_id", F.posexplode("dataset_refs").alias("ref_order", "dataset"))
    return refs.join(datasets, "dataset")


def variant_dataset_cross(plan: DataFrame, datasets: DataFrame) -> DataFrame:
    """Variants times datasets per workflow; a workflow without variants gets one NULL variant."""
    variants = plan.select("catalog_id", "dataset_refs", F.posexplode_outer("variants").alias("variant_order", "variant_id"))
    refs = variants.select(
        "catalog_id", F.coalesce("variant_order", F.lit(0)).alias("variant_order"), "variant_id",
        F.posexplode("dataset_refs").alias("ref_order", "dataset"),
    )
    return refs.join(datasets, "dataset")


# Parameters --------------------------------------------------------------------------------------


def expand_parameter(
    values: Column, low: Column, high: Column, step: Column, default: Column, strict_max: bool = False
) -> Column:
    """All values of a parameter: its list, else its range, else its default, else none.

    The range ends before ``high + step``, so it may pass ``high`` when the step does not divide the
    span; ``strict_max`` stops at ``high``.
    """
    step = F.coalesce(step, F.lit(1).cast("long"))
    last = high if strict_max else high + step - F.signum(step).cast("long")
    runs = (step != 0) & (F.signum(last - low) * F.signum(step) >= 0)
    spread = F.when(F.coalesce(runs, F.lit(False)), F.sequence(low, last, F.when(runs, step)))
    none = F.array().cast("array<string>")
    return F.coalesce(
        F.when(F.size(values) > 0, values),
        F.when(low.isNotNull() & high.isNotNull(), F.coalesce(spread.cast("array<string>"), none)),
        F.when(default.isNotNull(), F.array(default)),
        none,
    )


def dimensions(datasets: DataFrame, parameters: DataFrame) -> DataFrame:
    """``dataset`` with ``dims``: its parameters in order, each with name, pairwise flag and values."""
    values = expand_parameter(*[F.col(c) for c in ("values", "min", "max", "step", "default")])
    gathered = parameters.groupBy("dataset").agg(
        F.array_sort(
            F.collect_list(F.struct("ordinal", "param", F.coalesce("pairwise", F.lit(False)).alias("pairwise"), values.alias("values")))
        ).alias("dims")
    )
    joined = datasets.join(gathered, "dataset", "left")
    nothing = F.array().cast(gathered.schema["dims"].dataType)
    return joined.withColumn("dims", F.coalesce("dims", nothing))


def first_values(dims: Column) -> Column:
    """Parameter map with the first value of each parameter, NULL where it has none."""
    return F.map_from_entries(
        F.transform(dims, lambda d: F.struct(d["param"], F.try_element_at(d["values"], F.lit(1))))
    )


def cases_scenario_only(dims: DataFrame) -> DataFrame:
    return dims.select("dataset", F.lit(0).cast("long").alias("case_no"), first_values(F.col("dims")).alias("parameters"))


def _numbered(df: DataFrame, total: Column) -> DataFrame:
    """Rows 0..total-1 per input row, generated block by block."""
    blocks = F.when(total > 0, F.sequence(F.lit(0).cast("long"), F.expr(f"(_total - 1) div {_BLOCK}")))
    first = F.col("_block") * _BLOCK
    inside = F.sequence(first, F.least(first + _BLOCK - 1, F.col("_total") - 1))
    return (
        df.withColumn("_total", total)
        .where(F.col("_total") > 0)
        .withColumn("_block", F.explode(blocks))
        .withColumn("case_no", F.explode(inside))
        .drop("_block")
    )


def _product(sizes: Column) -> Column:
    """Product that stops at the largest long; a case number, being a long too, never reaches beyond it."""
    most = F.lit(_MOST).cast("long")
    return F.aggregate(sizes, F.lit(1).cast("long"), lambda acc, n: F.coalesce(F.try_multiply(acc, n), most))


def _sizes(dims: str = "dims") -> Column:
    return F.transform(dims, lambda d: F.size(d["values"]).cast("long"))


def cases_left_out(dims: DataFrame, max_cases: int) -> DataFrame:
    """Per dataset that a cap cuts: how many cases the product has and how many are left out."""
    sized = dims.select("dataset", _product(_sizes()).alias("total"))
    return sized.where(F.col("total") > max_cases).select("dataset", "total", (F.col("total") - max_cases).alias("left_out"))


def cases_cartesian(dims: DataFrame, max_cases: int | None = None) -> DataFrame:
    """The whole product, last parameter varying fastest, or its first ``max_cases``; :func:`cases_left_out` counts the rest.

    Without a cap, a product beyond the numbers of a long is an error.
    """
    sizes, total = _sizes(), _product(F.col("_sizes"))
    if max_cases is None:
        capped = F.when(total < _MOST, total).otherwise(F.raise_error(F.lit("the product has more cases than can be numbered")).cast("long"))
    else:
        capped = F.least(total, F.lit(max_cases).cast("long"))
    strides = F.transform(
        F.col("_sizes"), lambda n, i: _product(F.slice(F.col("_sizes"), i + 2, F.size("_sizes")))
    )
    numbered = _numbered(dims.withColumn("_sizes", sizes).withColumn("_strides", strides), capped)
    picked = F.transform(
        F.arrays_zip("dims", "_sizes", "_strides"),
        lambda z: F.struct(
            z["dims"]["param"],
            F.element_at(
                z["dims"]["values"],
                (F.call_function("div", F.col("case_no"), z["_strides"]) % z["_sizes"] + 1).cast("int"),
            ),
        ),
    )
    return numbered.select("dataset", "case_no", F.map_from_entries(picked).alias("parameters"))


def cases_naive(dims: DataFrame, max_cases: int | None = None) -> DataFrame:
    return cases_cartesian(dims, max_cases)


# Pairwise ----------------------------------------------------------------------------------------


def _least_prime(at_least: Column) -> Column:
    """Smallest prime not below a number of two or more (one exists below its double)."""
    candidates = F.sequence(at_least, at_least * 2)
    return F.element_at(
        F.filter(
            candidates,
            lambda x: (x < 4)
            | F.forall(F.sequence(F.lit(2), F.greatest(F.lit(2), F.floor(F.sqrt(x)).cast("int"))), lambda d: x % d != 0),
        ),
        1,
    )


def _arrays(dims: DataFrame) -> DataFrame:
    """Per dataset the levels of its dimensions, the prime ``_p`` and the number of rows of its orthogonal array."""
    sized = dims.where(F.size("dims") > 0).withColumn("_sizes", F.transform("dims", lambda d: F.size(d["values"])))
    p = _least_prime(F.greatest(F.array_max("_sizes"), F.size("dims") - 1, F.lit(2))).cast("long")
    alone = F.element_at("_sizes", 1).cast("long")
    return sized.withColumn("_p", p).withColumn("_total", F.when(F.size("dims") == 1, alone).otherwise(F.col("_p") * F.col("_p")))


def _cells() -> Column:
    """Levels in row ``case_no`` of the orthogonal array OA(p^2, p+1, p, 2), cut to each dimension's levels (Bush 1952).

    Row ``r = i * p + j`` has ``i`` in the first column and ``(i * (c - 1) + j) mod p`` in column ``c``.
    """
    i, j = F.floor(F.col("case_no") / F.col("_p")), F.col("case_no") % F.col("_p")
    single = F.size("_sizes") == 1
    return F.transform(
        "_sizes",
        lambda n, c: F.when(single, F.col("case_no"))
        .when(c == 0, i % n)
        .otherwise(((i * (c - 1) + j) % F.col("_p")) % n)
        .cast("int"),
    )


def _cell_pairs(cells: Column) -> Column:
    """Level pairs of every two columns of one row."""
    numbered = F.transform(cells, lambda v, c: F.struct(c.alias("c"), v.alias("v")))
    return F.flatten(
        F.transform(
            numbered,
            lambda a: F.transform(
                F.filter(numbered, lambda b: b["c"] > a["c"]),
                lambda b: F.struct(a["c"].alias("c1"), b["c"].alias("c2"), a["v"].alias("v1"), b["v"].alias("v2")),
            ),
        )
    )


def pairwise_dims(dims: DataFrame) -> DataFrame:
    """Keep the parameters that are paired and have values."""
    return dims.withColumn("dims", F.filter("dims", lambda d: d["pairwise"] & (F.size(d["values"]) > 0)))


def cases_pairwise(dims: DataFrame) -> DataFrame:
    """Cases in which every two dimensions show every pair of their values at least once.

    A row of the array is kept when it is the first to show some pair, so no pair is lost.
    """
    arrays = _arrays(dims)
    rows = _numbered(arrays.select("dataset", "_sizes", "_p", "_total"), F.col("_total"))
    alone = rows.where(F.size("_sizes") == 1).select("dataset", "case_no")
    pairs = rows.where(F.size("_sizes") > 1).select("dataset", "case_no", F.inline(_cell_pairs(_cells())))
    first = pairs.groupBy("dataset", "c1", "c2", "v1", "v2").agg(F.min("case_no").alias("case_no"))
    kept = first.select("dataset", "case_no").distinct().unionByName(alone)
    named = F.transform(
        F.arrays_zip("dims", "cells"),
        lambda z: F.struct(z["dims"]["param"], F.element_at(z["dims"]["values"], z["cells"] + 1)),
    )
    # a kept row is computed from its number, so the array is not made a second time
    return (
        kept.join(arrays, "dataset")
        .where(F.col("case_no") < F.col("_total"))
        .withColumn("cells", _cells())
        .select("dataset", "case_no", F.map_from_entries(named).alias("parameters"))
    )


def pairwise_coverage(dims: DataFrame, cases: DataFrame) -> DataFrame:
    """Value pairs that ``cases`` ought to show and do not."""
    flat = F.transform(
        "dims", lambda d, c: F.struct(c.alias("c"), d["param"].alias("param"), d["values"].alias("values"))
    )
    couples = dims.withColumn("_flat", flat).select(
        "dataset", F.explode("_flat").alias("a"), F.col("_flat").alias("_rest")
    ).select("dataset", "a", F.explode(F.filter("_rest", lambda b: b["c"] > F.col("a")["c"])).alias("b"))
    required = couples.select(
        "dataset", F.col("a.param").alias("p1"), F.col("b.param").alias("p2"), F.explode("a.values").alias("v1"), "b"
    ).select("dataset", "p1", "p2", "v1", F.explode("b.values").alias("v2"))
    entries = F.map_entries("parameters")
    shown = (
        cases.select("dataset", F.explode(entries).alias("a"), entries.alias("_all"))
        .select("dataset", "a", F.explode("_all").alias("b"))
        .select(
            "dataset", F.col("a.key").alias("p1"), F.col("b.key").alias("p2"),
            F.col("a.value").alias("v1"), F.col("b.value").alias("v2"),
        )
        .distinct()
    )
    return required.join(shown, ["dataset", "p1", "p2", "v1", "v2"], "left_anti")


def cases_hierarchical(dims: DataFrame, paired: int = HIERARCHICAL_DIMS) -> DataFrame:
    """Pair the first dimensions, hold the others at their first value."""
    head = dims.withColumn("dims", F.slice("dims", 1, paired))
    rest = dims.select("dataset", first_values(F.slice("dims", paired + 1, F.size("dims"))).alias("_rest"))
    return (
        cases_pairwise(head)
        .join(rest, "dataset")
        .select("dataset", "case_no", F.map_concat("parameters", "_rest").alias("parameters"))
    )


def limit_cases(cases: DataFrame, keys: Sequence[str], max_cases: int, seed: int | None = None) -> DataFrame:
    """At most ``max_cases`` per group: a seeded draw without replacement, or the first ones.

    The window is filtered by rank, which Spark turns into a limit per task before the shuffle.
    """
    order = [F.col("case_no")]
    if seed is not None:
        order.insert(0, draw_order(seed, *keys, "case_no"))
    ranked = cases.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= max_cases).drop("_rank")


def cases_from_flows(dims: DataFrame, flows: DataFrame) -> DataFrame:
    """One case per conversation flow with first-value parameters."""
    return _flow_cases(flows.join(dims, "dataset"))


def _flow_cases(joined: DataFrame) -> DataFrame:
    return joined.select(
        "dataset",
        F.col("flow_no").cast("long").alias("case_no"),
        first_values(F.col("dims")).alias("parameters"),
        F.col("title").alias("flow"),
    )


def _tagged(datasets: DataFrame, parameters: DataFrame, flows: DataFrame) -> DataFrame:
    """Checkpointed ``dataset, dims, flow_no, title, kind``: what each dataset, or each of its flows, makes cases from.

    ``kind`` is ``flow``, ``paired`` or ``bare``; parameters and flows are read once. A flow needs the first values only.
    """
    dims = dimensions(datasets.select("dataset"), parameters)
    joined = dims.join(flows.select("dataset", "flow_no", "title", F.lit(True).alias("_flow")), "dataset", "left")
    first = F.transform("dims", lambda d: d.withField("values", F.slice(d["values"], 1, 1)))
    pairs = F.exists("dims", lambda d: d["pairwise"] & (F.size(d["values"]) > 0))
    kind = F.when(F.col("_flow"), "flow").when(pairs, "paired").otherwise("bare")
    lean = F.when(F.col("_flow"), first).otherwise(F.col("dims"))
    return checkpointed(joined.select("dataset", lean.alias("dims"), "flow_no", "title", kind.alias("kind")))


def generate_cases(
    plan: DataFrame,
    datasets: DataFrame,
    parameters: DataFrame,
    flows: DataFrame,
    mode: str = "pairwise",
    max_cases: int | None = None,
    seed: int | None = None,
) -> DataFrame:
    """Test cases of a whole plan.

    Flows come before parameters. In pairwise mode a dataset without paired dimensions gets one
    first-value case; any number of dimensions is paired. The hierarchical mode pairs only the first five. ``max_cases``
    limits the cases of a dataset only if given.
    """
    if mode not in ("scenario_only", "cartesian", "pairwise", "hierarchical"):
        raise ValueError(f"unknown mode {mode}")
    tagged = _tagged(datasets, parameters, flows)
    plain = tagged.where(F.col("kind") != "flow")
    if mode == "scenario_only":
        made = cases_scenario_only(plain)
    elif mode == "cartesian":
        made = cases_cartesian(plain, max_cases)
    else:
        paired = pairwise_dims(plain.where(F.col("kind") == "paired")).select("dataset", "dims")
        made = cases_pairwise(paired) if mode == "pairwise" else cases_hierarchical(paired)
        if max_cases is not None:
            made = limit_cases(made, ["dataset"], max_cases, seed)
        made = made.unionByName(cases_scenario_only(plain.where(F.col("kind") == "bare")))
    cases = made.withColumn("flow", F.lit(None).cast("string")).unionByName(_flow_cases(tagged.where(F.col("kind") == "flow")))
    enabled = plan.where(F.coalesce("enabled", F.lit(True)))
    return (
        variant_dataset_cross(enabled, datasets)
        .join(cases, "dataset")
        .select(
            F.col("catalog_id").alias("workflow_id"), "dataset", "scenario", "variant_id", "case_no", "parameters", "flow",
            F.lit(seed).cast("long").alias("seed"),
        )
    )


# Manifests, tasks, patches and sampling ----------------------------------------------------------


def case_key() -> Column:
    """Text that identifies a case within a plan."""
    entries = F.transform(F.map_entries("parameters"), lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit(""))))
    return F.concat_ws(
        "|", "workflow_id", F.coalesce("variant_id", F.lit("default")), "dataset",
        F.col("case_no").cast("string"), F.array_join(entries, ";"),
    )


def build_manifests(cases: DataFrame, catalog: DataFrame) -> DataFrame:
    """One header per workflow and variant with its case count.

    The cases stay rows keyed by ``workflow_id`` and variant, as one manifest may hold very many. Workflows
    that the catalog lacks, or that have no cases, do not appear.
    """
    known = catalog.select(F.col("id").alias("workflow_id"), F.coalesce("version", F.lit("unknown")).alias("workflow_version"))
    return (
        cases.groupBy("workflow_id", F.coalesce("variant_id", F.lit("default")).alias("variant_id"))
        .agg(F.count(F.lit(1)).alias("cases"))
        .join(known, "workflow_id")
    )


def build_tasks(
    cases: DataFrame, max_attempts: int = 3, backoff_seconds: float = 2.0, timeout_per_task: float = 300.0
) -> DataFrame:
    """One pending task per case; the id is a hash of the case, so a rerun yields the same tasks."""
    return cases.select(
        F.sha2(case_key(), 256).alias("task_id"),
        "workflow_id",
        "dataset",
        "variant_id",
        F.lit("pending").alias("task_status"),
        F.lit(0).alias("attempt_count"),
        F.lit(timeout_per_task).alias("timeout_seconds"),
        F.lit(max_attempts - 1).alias("max_retries"),
        F.lit(backoff_seconds).alias("retry_backoff"),
    )


def render_template(template: Column, variables: Column) -> Column:
    """Replace ``{{ name }}`` for every variable of a string map."""
    return F.aggregate(
        F.map_entries(variables),
        template,
        lambda acc, e: F.regexp_replace(
            acc,
            F.concat(F.lit(r"\{\{\s*\Q"), e["key"], F.lit(r"\E\s*\}\}")),
            F.replace(F.replace(e["value"], F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$")),
        ),
    )


def apply_variant_patches(nodes: DataFrame, patches: DataFrame) -> DataFrame:
    """Patched node texts per variant: a path match beats an id match beats label with type.

    ``nodes``: ``workflow_id, node_id, label, type, path, text``. ``patches``: ``workflow_id, variant_id,
    patch_no, by_path, by_id, by_label, by_type, mode, content, variables``. Untouched nodes are not
    returned.
    """
    body = ["variant_id", "patch_no", "mode", "content", "variables"]

    def matched(rank: int, where: Column, on: dict[str, str]) -> DataFrame:
        renamed = patches.where(where).select("workflow_id", *[F.col(s).alias(n) for s, n in on.items()], *body)
        return nodes.join(renamed, ["workflow_id", *on.values()]).withColumn("_rank", F.lit(rank)).select(
            *nodes.columns, *body, "_rank"
        )

    found = (
        matched(0, F.col("by_path").isNotNull(), {"by_path": "path"})
        .unionByName(matched(1, F.col("by_id").isNotNull(), {"by_id": "node_id"}))
        .unionByName(matched(2, F.col("by_label").isNotNull() & F.col("by_type").isNotNull(), {"by_label": "label", "by_type": "type"}))
    )
    best = found.groupBy("workflow_id", "variant_id", "node_id").agg(
        F.min_by(F.struct("text", "mode", "content", "variables"), F.struct("_rank", "patch_no")).alias("p")
    )
    text, content = F.col("p.text"), F.col("p.content")
    new = (
        F.when(F.col("p.mode") == "replace", content)
        .when(F.col("p.mode") == "prepend", F.concat(content, F.lit("\n"), text))
        .when(F.col("p.mode") == "append", F.concat(text, F.lit("\n"), content))
        .when(F.col("p.mode") == "template", render_template(content, F.col("p.variables")))
        .otherwise(text)
    )
    return best.select("workflow_id", "variant_id", "node_id", new.alias("text"))


def weighted_sample(rows: DataFrame, key: str, weight: str, k: int, seed: int = 0) -> DataFrame:
    """``k`` rows without replacement, chance in proportion to weight (exponential race on a digest)."""
    digits = F.conv(F.left(draw_order(seed, key), F.lit(12)), 16, 10).cast("double")
    u = (digits + 0.5) / float(1 << 48)
    return rows.where(F.col(weight) > 0).orderBy(-F.log(u) / F.col(weight), key).limit(k)


def run_index(runs: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return with_position(runs, keys, order, "run_index")
