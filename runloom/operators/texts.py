"""Jobs over tables of prompts, outputs and model answers."""

from __future__ import annotations

import difflib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions import prompts as P
from runloom.functions import text as T
from runloom.functions.payload import at

GRAM = 6  # code points of the grams that constraints are found by
FEW = 64  # constraints of a key up to which each output is searched for all of them
SOFT_MATCH = 0.55  # fixed value: similarity from which an output counts as matching its reference


# Similarity --------------------------------------------------------------------------------------


def _ratios(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    matcher = difflib.SequenceMatcher(None)
    for left, right in batches:
        out = []
        for a, b in zip(left, right):
            matcher.set_seqs(a or "", b or "")
            out.append(matcher.ratio())
        yield pd.Series(out, dtype="float64")


def _reaches(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Whether the ratio reaches a limit; cheap upper bounds answer most pairs."""
    matcher = difflib.SequenceMatcher(None)
    for left, right, limit in batches:
        out = []
        for a, b, least in zip(left, right, limit):
            matcher.set_seqs(a, b)
            out.append(
                matcher.real_quick_ratio() >= least and matcher.quick_ratio() >= least and matcher.ratio() >= least
            )
        yield pd.Series(out, dtype="bool")


def _pair_key(a: Column, b: Column) -> Column:
    return F.sha2(F.concat_ws("/", F.sha2(F.coalesce(a, F.lit("")), 256), F.sha2(F.coalesce(b, F.lit("")), 256)), 256)


def _over_distinct_pairs(rows: DataFrame, a: str, b: str, score: Column, name: str) -> DataFrame:
    """Evaluate ``score`` once per distinct pair and join it back.

    Copies of one pair meet in a partial aggregate before the shuffle; the pairs are then spread evenly
    again, so that long texts do not pile up in one task.
    """
    keyed = rows.withColumn("_pair", _pair_key(F.col(a), F.col(b)))
    pairs = keyed.groupBy("_pair").agg(F.any_value(a).alias("_a"), F.any_value(b).alias("_b"))
    scored = pairs.select("_pair", score.alias(name))
    return keyed.join(scored, "_pair").drop("_pair")


def with_similarity(rows: DataFrame, a: str, b: str, name: str = "similarity") -> DataFrame:
    """Ratcliff-Obershelp ratio of two text columns, on the whole texts; not symmetric."""
    ratio = F.pandas_udf(_ratios, "double")
    return _over_distinct_pairs(rows, a, b, ratio(F.col("_a"), F.col("_b")), name)


def soft_reference_match(rows: DataFrame, reference: str, output: str, threshold: float = SOFT_MATCH) -> DataFrame:
    """Add ``matches``: similarity of at least ``threshold``; false when either text is empty.

    Pairs whose lengths alone rule the threshold out never reach Python.
    """
    la, lb = F.length(reference), F.length(output)
    bound = F.try_divide(2.0 * F.least(la, lb), la + lb)
    possible = F.coalesce((la > 0) & (lb > 0) & (bound >= threshold), F.lit(False))
    split = rows.withColumn("_possible", possible)
    reaches = F.pandas_udf(_reaches, "boolean")
    judged = _over_distinct_pairs(
        split.where("_possible"), reference, output, reaches(F.col("_a"), F.col("_b"), F.lit(threshold)), "matches"
    )
    return judged.unionByName(split.where(~F.col("_possible")).withColumn("matches", F.lit(False))).drop("_possible")


# Prompts -----------------------------------------------------------------------------------------


def guard_rewrite(rows: DataFrame, text: str, rewritten: str, name: str = "guarded") -> DataFrame:
    """Accept a rewrite of the masked text only when every placeholder survives as often as before, and every role marker.

    ``rewritten`` holds the rewritten text with markers masked as ``[[ROLE_MARKER_i]]`` and placeholders as ``<<<PH_i>>>``;
    anything else keeps the old text. Without placeholders a non-empty rewrite is taken as it is, if its markers are there.
    """
    staged = rows.withColumns({"_markers": T.role_markers(F.col(text)), "_unmarked": T.mask_role_markers(F.col(text))})
    old = F.col("_unmarked")
    staged = staged.withColumn("_tokens", T.placeholders(old))
    staged = staged.withColumn("_masked", T.mask_placeholders(old, F.col("_tokens")))
    new = F.when(T.non_empty(F.col(rewritten)), F.col(rewritten)).otherwise(F.col("_masked"))
    staged = staged.withColumn("_new", new)
    staged = staged.withColumn("_restored", T.restore_placeholders(F.col("_new"), F.col("_tokens")))
    sound = T.tokens_intact(F.col("_masked"), F.col("_new"), F.col("_tokens")) & T.placeholders_preserved(
        F.col("_tokens"), F.col("_restored")
    )
    kept = T.role_markers_kept(F.col("_restored"), F.col("_markers"))
    taken = F.when(((F.size("_tokens") == 0) | sound) & kept, T.restore_role_markers(F.col("_restored"), F.col("_markers")))
    return staged.withColumn(name, F.coalesce(taken, F.col(text))).drop("_tokens", "_masked", "_new", "_restored", "_markers", "_unmarked")


def skip_for_intent(prompt: Column, constraints: Column, expected: Column) -> Column:
    """Whether a prompt shares too few keywords with its reference to be worth changing."""
    def decided(words: Column) -> Column:
        wanted, own = words["wanted"], words["own"]
        overlap = F.size(F.array_intersect(wanted, own))
        far = (F.try_divide(overlap, F.size(wanted)) < 0.15) & (overlap <= 1)
        return F.when(F.size(wanted) == 0, False).when(F.size(own) == 0, True).otherwise(far)

    wanted = T.keywords(F.array_join(F.concat(constraints, expected), " "))
    return T.let(F.struct(wanted.alias("wanted"), T.keywords(prompt).alias("own")), decided)


def _constraint_rows(specs: DataFrame, key: str) -> DataFrame:
    """One row per ``key`` and distinct constraint that is not empty, with its number and its lower-case text."""
    wanted = F.filter(F.array_distinct("constraints"), T.non_empty)
    return specs.select(key, F.posexplode(wanted).alias("constraint_no", "constraint")).withColumn("_low", F.lower("constraint"))


def constraint_index(specs: DataFrame, key: str = "workflow_id") -> DataFrame:
    """Inverted index of a key's constraints, one row per ``key``: ``grams`` and, for each, the constraints behind it.

    Each constraint stands under one of its 6-grams, the one that fewest constraints of the key have: a text without that gram
    cannot show the constraint. Constraints that are shorter than that stand under no gram, and any text may show them.
    """
    rows = _constraint_rows(specs, key)
    grams = F.array_distinct(_grams(F.col("_low")))
    spread = rows.select(key, "constraint_no", F.explode(grams).alias("gram"))
    common = spread.groupBy(key, "gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = spread.join(common, [key, "gram"]).groupBy(key, "constraint_no").agg(F.min(F.struct("_n", "gram"))["gram"].alias("gram"))
    listed = rows.join(rarest, [key, "constraint_no"], "left").groupBy(key, "gram").agg(
        F.sort_array(F.collect_list(F.struct("constraint_no", "constraint", F.col("_low").alias("low")))).alias("items")
    )
    entry = F.struct("gram", "items")
    return listed.groupBy(key).agg(F.collect_list(entry).alias("entries"), F.collect_list("gram").alias("grams"), F.sum(F.size("items")).alias("n_constraints"))


def _grams(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))


def constraint_candidates(samples: DataFrame, specs: DataFrame, key: str = "workflow_id") -> DataFrame:
    """``samples`` of keys with constraints and, in ``_low`` and ``_items``, the lower-case output and the constraints to look for in it.

    Long lists are looked up in their index by the grams of the output; of lists of up to ``FEW`` constraints, which are
    searched faster than grams are made, all are looked for.
    """
    low = F.lower(F.coalesce("output_text", F.lit("")))
    joined = samples.join(constraint_index(specs, key), key).withColumn("_low", low)

    def named(entries: Column) -> Column:
        return F.flatten(F.transform(entries, lambda e: e["items"]))

    probed = T.let(
        F.array_intersect(_grams(F.col("_low")), F.col("grams")),
        lambda found: named(F.filter("entries", lambda e: e["gram"].isNull() | F.array_contains(found, e["gram"]))),
    )
    items = F.when(F.col("n_constraints") <= FEW, named(F.col("entries"))).otherwise(probed)
    return joined.withColumn("_items", items).drop("entries", "grams", "n_constraints")


def constraint_hits(samples: DataFrame, specs: DataFrame, key: str = "workflow_id", shown: Sequence[str] = ()) -> DataFrame:
    """One row per sample and constraint that its output shows, in any case; the output text itself is not copied.

    ``specs`` has one row per ``key`` with its ``constraints``. ``shown`` are the columns that tell a sample, ``key`` and
    ``index`` unless named.
    """
    columns = list(shown) or [key, "index"]
    hits = F.filter("_items", lambda c: F.contains(F.col("_low"), c["low"]))
    found = constraint_candidates(samples, specs, key).select(*columns, F.inline(hits))
    return found.select(*columns, "constraint_no", "constraint")


def constraint_coverage(samples: DataFrame, specs: DataFrame, key: str = "workflow_id", hits: DataFrame | None = None) -> DataFrame:
    """How many outputs of a workflow there are, and how many show each of its constraints.

    Only what is shown becomes a row; runs are counted once a key and not once a constraint. ``hits`` are the rows of
    :func:`constraint_hits`, if they are there already: the outputs are not read then.
    """
    runs = samples.groupBy(key).agg(F.count(F.lit(1)).alias("runs"))
    hits = constraint_hits(samples, specs, key) if hits is None else hits
    shown = hits.groupBy(key, "constraint_no").agg(F.count(F.lit(1)).alias("_found"))
    every = _constraint_rows(specs, key).drop("_low").join(runs, key).join(shown, [key, "constraint_no"], "left")
    return every.select(key, "constraint_no", "constraint", "runs", F.coalesce("_found", F.lit(0).cast("long")).alias("found"))


def parse_sections(rows: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    return P.with_sections(rows, text).select(*keys, F.explode("sections").alias("section", "body"))


def split_text_blocks(rows: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    return rows.select(*keys, F.inline(P.text_blocks(F.col(text))).alias("block_no", "block_id", "kind", "text"))


def merge_text_blocks(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Concatenate the blocks of each prompt; a prompt was one cell before it was split."""
    ordered = F.array_sort(F.collect_list(F.struct("block_no", "text")))
    gathered = blocks.groupBy(*keys).agg(ordered.alias("_b"))
    return gathered.select(*keys, F.array_join(F.transform("_b", lambda b: b["text"]), "").alias("text"))


def replace_text_block(blocks: DataFrame, replacements: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blocks with the texts of ``replacements`` (keys, ``block_id``, ``content``) put in."""
    new = replacements.select(*keys, "block_id", "content")
    joined = blocks.join(new, [*keys, "block_id"], "left")
    return joined.withColumn("text", P.replaced_block(F.col("text"), F.col("content"))).drop("content")


def merge_messages(messages: DataFrame, keys: Sequence[str], part_messages: int) -> DataFrame:
    """Messages of a node merged into one marked text.

    A node with more than ``part_messages`` messages yields several parts, whose texts joined by line
    breaks are the whole, so no node has to fit one task. ``messages`` lists role and index of a part.
    """
    role = F.coalesce(F.nullif("role", F.lit("")), F.lit("user"))
    text = F.coalesce("text", F.lit(""))
    entry = F.struct(F.col("index").alias("index"), role.alias("role"), P.marked(role, F.col("index"), text).alias("marked"))
    part = F.floor(F.col("index") / part_messages).cast("long").alias("part")
    gathered = messages.groupBy(*keys, part).agg(F.array_sort(F.collect_list(entry)).alias("_m"))
    return gathered.select(
        *keys,
        "part",
        F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["index"].alias("index"))).alias("messages"),
        F.array_join(F.transform("_m", lambda m: m["marked"]), "\n").alias("merged_text"),
    )


def split_messages(blocks: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Messages of a merged text by its markers; a block that lost a marker is left out entirely."""
    def found(new: Column) -> Column:
        return F.transform(
            "messages",
            lambda m: F.struct(
                m["role"].alias("role"), m["index"].alias("index"), P.between_markers(new, m["role"], m["index"]).alias("text")
            ),
        )

    whole = T.let(
        T.let(F.col(text), found), lambda parts: F.when(F.forall(parts, lambda m: m["text"].isNotNull()), parts)
    )
    return blocks.select(*keys, F.inline(whole))


# Model answers -----------------------------------------------------------------------------------


def parse_judge_verdict(rows: DataFrame, raw: str) -> DataFrame:
    """Verdict, missing and incorrect items, format flag, severity and reason of judge answers.

    Anything missing, incorrect or badly formed fails; an answer that cannot be read fails with high
    severity unless it plainly says pass. Empty answers drop out.
    """
    answered = rows.where(T.non_empty(F.col(raw))).withColumn("_j", T.json_object(F.col(raw)))
    readable = T.is_json_object(F.col("_j"))
    v = F.when(readable, F.col("_j"))

    def items(name: str) -> Column:
        return F.coalesce(F.try_variant_get(v, f"$.{name}", "array<string>"), F.array().cast("array<string>"))

    low = F.lower(raw)
    spoken = F.nullif(F.lower(at(v, "$.verdict")), F.lit(""))
    guess = F.when(low.contains("fail"), "fail").when(low.contains("pass"), "pass").otherwise("fail")
    flag = F.lower(at(v, "$.format_ok"))
    staged = answered.withColumns(
        {
            "_readable": readable,
            "_said": F.coalesce(spoken, guess),
            "missing_items": items("missing_items"),
            "incorrect_items": items("incorrect_items"),
            "_fmt": F.coalesce(~flag.isin("false", "0", "", "[]", "{}"), F.when(readable & F.coalesce(F.is_variant_null(F.try_variant_get(v, "$.format_ok", "variant")), F.lit(False)), False).otherwise(True)),
            "_reason": F.coalesce(F.nullif(T.coerced_text(F.try_variant_get(v, "$.reason", "variant")), F.lit("")), F.col(raw)),
            "_given": F.nullif(F.lower(at(v, "$.severity")), F.lit("")),
        }
    )
    missing, incorrect = F.size("missing_items") > 0, F.size("incorrect_items") > 0
    clean = (F.col("_said") == "pass") & ~missing & ~incorrect & F.col("_fmt")
    inferred = F.when(incorrect | (missing & ~F.col("_fmt")), "high").otherwise("medium")
    severity = F.when(~F.col("_readable"), "high").otherwise(F.coalesce("_given", inferred))
    fmt = F.col("_fmt") & (F.col("_readable") | clean)
    return staged.withColumns(
        {
            "passed": clean,
            "verdict": F.when(clean, "pass").when(F.col("_said") == "pass", "fail").otherwise(F.col("_said")),
            "format_ok": fmt,
            "severity": F.when(~clean, F.when(severity.isin("low", "medium", "high"), severity).otherwise("medium")),
            "message": F.when(
                ~clean,
                F.concat(
                    F.lit("LLM judge flagged mismatch: "), F.col("_reason"),
                    F.lit(" | missing_items="), P.listed(F.col("missing_items")),
                    F.lit(" | incorrect_items="), P.listed(F.col("incorrect_items")),
                    F.lit(" | format_ok="), F.when(fmt, "True").otherwise("False"),
                ),
            ),
        }
    ).drop("_j", "_readable", "_said", "_fmt", "_reason", "_given")


def parse_action_judge(rows: DataFrame, raw: str) -> DataFrame:
    """Verdict and proposed actions of an action judge; unreadable answers are searched for pass or fail."""
    parsed = rows.withColumn("_j", T.json_object(F.col(raw)))
    v = F.when(T.is_json_object(F.col("_j")), F.col("_j"))
    low = F.lower(raw)
    guess = F.when(low.contains("pass"), "pass").otherwise("fail")
    shaped = F.transform(
        F.filter(F.try_variant_get(v, "$.actions", "array<variant>"), T.is_json_object),
        lambda a: F.struct(
            F.coalesce(at(a, "$.type"), at(a, "$.action")).alias("type"), at(a, "$.target").alias("target"), at(a, "$.content").alias("content")
        ),
    )
    none = F.array().cast("array<struct<type:string,target:string,content:string>>")
    return parsed.withColumns(
        {
            "verdict": F.coalesce(F.nullif(F.lower(at(v, "$.verdict")), F.lit("")), guess),
            "actions": F.coalesce(shaped, none),
        }
    ).drop("_j")
