"""From recorded runs to issues, actions, prompt patches and the report of one round."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions import text as T
from runloom.operators import dsl, issues, texts
from runloom.operators.actions import ACTION, head_actions
from runloom.operators.metrics import optimization_stats
from runloom.session import checkpointed


@dataclass
class Round:
    """Tables of one round: issues and actions as heads with their evidence, patches, and counts per workflow.

    Issues are looked for when they are first asked for, so a round that is only asked for its patches costs no detection.
    """

    patches: DataFrame
    stats: DataFrame
    _inputs: tuple = field(repr=False)

    @cached_property
    def issues(self) -> DataFrame:
        """One row per issue; see :mod:`runloom.operators.issues`."""
        samples, specs, judged = self._inputs
        return checkpointed(issues.detect_heads(samples, specs, judged))

    @cached_property
    def _derived(self) -> tuple[DataFrame, DataFrame]:
        samples, specs, _ = self._inputs
        return head_actions(self.issues, issues.evidence_sets(samples, specs, self.issues), specs)

    @property
    def actions(self) -> DataFrame:
        """One row per action with ``evidence_count``."""
        return self._derived[0]

    @property
    def evidence(self) -> DataFrame:
        """The bitmaps that issues and actions refer to."""
        return self._derived[1]


def optimize_runs(
    samples: DataFrame,
    specs: DataFrame,
    blocks: DataFrame,
    rewrites: DataFrame,
    references: DataFrame,
    judged: DataFrame | None = None,
    needs_change: DataFrame | None = None,
    context: Column | None = None,
) -> Round:
    """Detect issues, derive actions and turn supplied rewrites into patches.

    ``blocks`` are prompt blocks with ``workflow_id, tree_id``; ``rewrites`` has ``tree_id, node_id`` and
    ``rewritten``; ``needs_change`` may name the blocks a prompt judge wants changed or, with a column ``answer``, hold what it
    said: a plain yes or no decides, any other answer changes the blocks of workflows with issues. Blocks that share no
    keywords with the reference are skipped, and rewrites that lose markers or placeholders are refused. ``context``, a column of
    ``specs`` with the name and description of a workflow, adds its description to what a prompt should be about.
    """
    described = F.array() if context is None else F.array_compact(F.array(T.workflow_context(context)["description"]))
    about = F.concat(F.coalesce("constraints", F.array().cast("array<string>")), described.cast("array<string>"))
    wanted = specs.select("workflow_id", about.alias("constraints"), "expected_outputs")
    skipped = texts.skip_for_intent(
        F.col("merged_text"),
        F.coalesce("constraints", F.array().cast("array<string>")),
        F.coalesce("expected_outputs", F.array().cast("array<string>")),
    )
    asked = blocks.join(wanted, "workflow_id", "left").withColumn("skipped", skipped)
    if needs_change is None:
        marked = asked.withColumn("needs_change", F.lit(True))
    elif "answer" in needs_change.columns:
        said = needs_change.select("tree_id", "node_id", "answer").dropDuplicates(["tree_id", "node_id"])
        heads = issues.detect_heads(samples, specs, judged).select("workflow_id").distinct().withColumn("_issues", F.lit(True))
        answered = asked.join(said, ["tree_id", "node_id"], "left").join(heads, "workflow_id", "left")
        decided = T.yes_or_no(F.coalesce("answer", F.lit("")), F.coalesce("_issues", F.lit(False)))
        marked = answered.withColumn("needs_change", decided).drop("answer", "_issues")
    else:
        named = needs_change.select("tree_id", "node_id").distinct().withColumn("_named", F.lit(True))
        marked = asked.join(named, ["tree_id", "node_id"], "left").withColumn("needs_change", F.coalesce("_named", F.lit(False)))
    open_blocks = marked.where(F.col("needs_change") & ~F.col("skipped"))
    rewritten = open_blocks.join(rewrites.select("tree_id", "node_id", "rewritten"), ["tree_id", "node_id"])
    patches = dsl.diff_prompts(rewritten, ["workflow_id", "tree_id"], "rewritten")
    stats = optimization_stats(samples, references, marked.select("workflow_id", "skipped", "needs_change"))
    return Round(patches, stats, (samples, specs, judged))


def patches_report(result: Round) -> DataFrame:
    """Report of a round as rows ``workflow_id, section, entry``: issues, actions, patches and stats.

    Every entry is one JSON object; a workflow's report is all its rows, however many there are.
    """
    parts = {
        "issues": issues.with_evidence_count(result.issues, result.evidence).select("workflow_id", *issues.SHOWN, "evidence_count"),
        "actions": result.actions.select("workflow_id", *ACTION, "evidence_count"),
        "patches": result.patches,
        "stats": result.stats,
    }
    out = None
    for section, rows in parts.items():
        fields = F.to_json(F.struct(*[c for c in rows.columns if c != "workflow_id"]))
        shaped = rows.select("workflow_id", F.lit(section).alias("section"), fields.alias("entry"))
        out = shaped if out is None else out.unionByName(shaped)
    return out


def step_timeline(trials: DataFrame, key: str) -> DataFrame:
    """One line per step: best score and its issue and action counts."""
    best = trials.groupBy(key, "step").agg(
        F.max_by(F.struct("score", "issues", "actions"), F.col("score")).alias("_b"), F.count(F.lit(1)).alias("concurrency")
    )
    return best.select(
        key, "step", F.col("_b.score").alias("score"), F.col("_b.issues").alias("issue_count"),
        F.col("_b.actions").alias("action_count"), "concurrency",
    )


def latest_state(checkpoints: DataFrame, key: str) -> DataFrame:
    """The newest saved state per key from an append-only table of steps."""
    others = [c for c in checkpoints.columns if c != key]
    newest = checkpoints.groupBy(key).agg(F.max_by(F.struct(*others), F.col("step")).alias("_s"))
    return newest.select(key, "_s.*")
