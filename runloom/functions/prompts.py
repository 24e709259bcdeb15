"""Structured prompts: sections, state, contract, blocks and markers, all inside one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions.text import (
    bullets,
    is_json_object,
    json_object,
    let,
    non_empty,
    occurrences,
    placeholders,
    rule_pairs,
    rules_of,
    strip,
)

# Section headers of a structured prompt and the contract placeholder.
HEADERS = (
    "ROLE", "TASK", "GLOBAL CONSTRAINTS", "CHECKPOINT RULES", "STRICTNESS LEVEL", "OUTPUT JSON SCHEMA", "JSON SCHEMA",
    "NEGATIVE EXAMPLES",
)
SECTIONS = ("role", "task", "global_constraints", "checkpoint_rules", "strictness_level", "schema", "negative_examples")
CONTRACT_PLACEHOLDER = "{{RESPONSE_CONTRACT}}"
CONTRACT = r"(?ms)^(OUTPUT JSON SCHEMA|JSON SCHEMA|OUTPUT FORMAT):\n(.*?)(?=^\S.*?:\n|\z)"
# Words that tell what a text block is about.
OUTPUT_CUES, EXAMPLE_CUES, CONSTRAINT_CUES = ("输出", "output"), ("示例", "example"), ("必须", "约束")

_HEADER_LINE = r"(?mi)^[^\S\r\n]*(" + "|".join(HEADERS) + r")[^\S\r\n]*:[^\S\r\n]*$"
_NO_TEXTS = "array<string>"


def header_pairs(text: Column) -> Column:
    """Section names with the text up to the next header, in order."""
    names = F.transform(
        F.regexp_extract_all(text, F.lit(_HEADER_LINE), F.lit(1)),
        lambda n: F.when(F.upper(n).endswith("SCHEMA"), "schema").otherwise(F.lower(F.replace(n, F.lit(" "), F.lit("_")))),
    )
    pieces = F.split(text, _HEADER_LINE)
    return F.arrays_zip(names.alias("name"), F.slice(pieces, F.lit(2), F.size(pieces)).alias("body"))


def sections_of(pairs: Column) -> Column:
    """Map of section name to body; the last header of a name counts and a header without lines gives nothing."""
    last = F.transform(
        F.array(*map(F.lit, SECTIONS)),
        lambda s: F.struct(
            s.alias("name"), F.try_element_at(F.filter(pairs, lambda p: p["name"] == s), F.lit(-1))["body"].alias("body")
        ),
    )
    present = F.filter(last, lambda p: p["body"].isNotNull() & ~p["body"].isin("", "\n", "\r\n", "\r"))
    tidy = F.transform(present, lambda p: F.struct(p["name"], strip(F.regexp_replace(p["body"], "\r\n?", "\n"))))
    return F.map_from_entries(tidy)


def with_sections(rows: DataFrame, text: str, name: str = "sections") -> DataFrame:
    """Add the section map; the text is scanned once."""
    return rows.withColumn(name, let(header_pairs(F.col(text)), sections_of))


def negative_examples(text: Column) -> Column:
    """``Wrong:`` / ``Reason:`` groups as structs; other lines extend the wrong output."""
    joined = F.array_join(bullets(text), "\n")
    chunks = F.filter(F.split(joined, r"(?mi)(?:\A|\n)(?=wrong:)"), lambda c: c != "")

    def example(chunk: Column) -> Column:
        rows = F.split(chunk, "\n")
        kept = F.filter(rows, lambda r: ~F.lower(r).startswith("reason:"))
        bad = strip(F.regexp_replace(F.array_join(kept, "\n"), r"(?i)\Awrong:\s*", ""))
        start = F.array_position(rows, F.try_element_at(kept, F.lit(1)))
        after = F.slice(rows, F.greatest(start, F.lit(1)).cast("int"), F.size(rows))
        reasons = F.filter(after, lambda r: F.lower(r).startswith("reason:"))
        reason = strip(F.regexp_replace(F.try_element_at(reasons, F.lit(-1)), r"(?i)\Areason:", ""))
        return F.struct(bad.alias("bad_output"), reason.alias("reason"), (F.size(kept) > 0).alias("_any"))

    found = F.filter(F.transform(chunks, example), lambda e: e["_any"])
    return F.transform(found, lambda e: F.struct(e["bad_output"].alias("bad_output"), e["reason"].alias("reason")))


def with_prompt_state(rows: DataFrame, text: str, constraints: Column, name: str = "state") -> DataFrame:
    """Add the slots of a prompt as one struct.

    A schema section becomes a locked contract; constraints of the reference are added when new; a text
    without sections is kept whole as the base prompt.
    """

    def part(section: str) -> Column:
        return F.coalesce(F.try_element_at("_sections", F.lit(section)), F.lit(""))

    staged = with_sections(rows, text, "_sections").withColumns(
        {
            "_own": bullets(part("global_constraints")),
            "_rules": rule_pairs(part("checkpoint_rules")),
            "_schema": F.when(part("schema") == CONTRACT_PLACEHOLDER, "").otherwise(part("schema")),
            "_level": F.nullif(F.regexp_extract(part("strictness_level"), r"(\d+)", 1), F.lit("")),
        }
    )
    structured = F.size("_sections") > 0
    strictness = F.when(F.col("_level").isNull(), 3).otherwise(
        F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(F.col("_level").try_cast("int"), F.lit(5))))
    )
    new = F.filter(F.array_distinct(constraints), lambda c: non_empty(c) & ~F.array_contains("_own", c))
    state = F.struct(
        F.when(structured, "").otherwise(F.col(text)).alias("base_prompt"),
        part("role").alias("role"),
        part("task").alias("task"),
        F.lit("").alias("schema"),
        rules_of(F.col("_rules")).alias("checkpoint_rules"),
        strictness.alias("strictness_level"),
        negative_examples(part("negative_examples")).alias("negative_examples"),
        F.concat(F.col("_own"), F.coalesce(new, F.array().cast(_NO_TEXTS))).alias("global_constraints"),
        placeholders(F.col(text)).alias("placeholders"),
        structured.alias("structured"),
        (F.col("_schema") != "").alias("schema_frozen"),
        F.lit(0).alias("schema_tighten_count"),
        F.lit(0).alias("version"),
        F.nullif("_schema", F.lit("")).alias("contract"),
    )
    return staged.withColumn(name, state).drop("_sections", "_own", "_rules", "_schema", "_level")


def render_state(state: Column) -> Column:
    """Text of a state under fixed headers, parts separated by blank lines; the contract is left out."""
    def titled(header: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.array(F.lit(header)), items)).otherwise(F.array().cast(_NO_TEXTS))

    examples = F.flatten(
        F.transform(
            state["negative_examples"],
            lambda e: F.array(
                F.when(non_empty(e["bad_output"]), F.concat(F.lit("- Wrong: "), e["bad_output"])),
                F.when(non_empty(e["reason"]), F.concat(F.lit("  Reason: "), e["reason"])),
            ),
        )
    )
    parts = F.concat(
        F.array(
            state["base_prompt"],
            F.when(state["role"] != "", F.concat(F.lit("ROLE:\n"), state["role"])),
            F.when(state["task"] != "", F.concat(F.lit("TASK:\n"), state["task"])),
        ),
        titled("GLOBAL CONSTRAINTS:", F.transform(state["global_constraints"], lambda c: F.concat(F.lit("- "), c))),
        titled("CHECKPOINT RULES:", F.transform(state["checkpoint_rules"], lambda r: F.concat(F.lit("- "), r["key"], F.lit(": "), r["value"]))),
        F.array(F.concat(F.lit("STRICTNESS LEVEL:\n"), state["strictness_level"].cast("string"))),
        titled("NEGATIVE EXAMPLES:", examples),
        titled("PLACEHOLDERS (MUST REMAIN EXACTLY):", F.transform(state["placeholders"], lambda p: F.concat(F.lit("- "), p))),
    )
    return F.array_join(F.filter(parts, non_empty), "\n\n")


# Response contract -------------------------------------------------------------------------------


def extract_contract(text: Column) -> Column:
    """Struct of the text with the first schema section replaced by a placeholder, its format and its body.

    Format and body are NULL, and the text unchanged, when there is no such section, it is empty, or the
    placeholder is already there.
    """
    whole = F.regexp_extract(text, CONTRACT, 0)
    header = F.regexp_extract(text, CONTRACT, 1)
    body = strip(F.regexp_extract(text, CONTRACT, 2))
    found = (header != "") & (body != "") & ~text.contains(CONTRACT_PLACEHOLDER)
    start = F.regexp_instr(text, F.lit(CONTRACT))
    replaced = F.concat(
        F.substr(text, F.lit(1), start - 1), header, F.lit(":\n" + CONTRACT_PLACEHOLDER), F.substr(text, start + F.length(whole))
    )
    return F.struct(
        F.when(found, replaced).otherwise(text).alias("text"),
        F.when(found, F.when(header.contains("JSON"), "json").otherwise("text")).alias("format_type"),
        F.when(found, body).alias("schema"),
    )


def restore_contract(text: Column, schema: Column, format_type: Column | None = None) -> Column:
    """Put the contract back: at its placeholder, else at the end under its header."""
    kind = F.lit("json") if format_type is None else format_type
    header = F.when(kind == "json", "OUTPUT JSON SCHEMA").otherwise("OUTPUT FORMAT")
    rendered = strip(F.concat(header, F.lit(":\n"), schema))
    return (
        F.when(schema.isNull(), text)
        .when(text.contains(CONTRACT_PLACEHOLDER), F.replace(text, F.lit(CONTRACT_PLACEHOLDER), schema))
        .when(strip(text) == "", rendered)
        .otherwise(F.concat(text, F.lit("\n\n"), rendered))
    )


def listed(items: Column) -> Column:
    """``['a', 'b']`` form of a string array."""
    quoted = F.transform(items, lambda i: F.concat(F.lit("'"), i, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def validate_contract(schema: Column, candidate: Column) -> Column:
    """What is wrong with an output under a JSON contract, NULL when nothing is."""
    required = let(
        json_object(schema), lambda s: F.when(is_json_object(s), F.try_variant_get(s, "$.required", "array<string>"))
    )

    def problem(output: Column) -> Column:
        keys = F.coalesce(F.json_object_keys(F.to_json(output)), F.array().cast(_NO_TEXTS))
        missing = let(
            F.array_except(required, keys),
            lambda m: F.when(F.size(m) > 0, F.concat(F.lit("ResponseContract missing required fields: "), listed(m))),
        )
        return F.when(~is_json_object(output), "ResponseContract requires valid JSON object output").otherwise(missing)

    return let(json_object(candidate), problem)


def schema_strength(text: Column) -> Column:
    """How strict a JSON schema is: closed object, required fields, properties and enum values."""

    def parsed_score(schema: Column) -> Column:
        extra = F.try_variant_get(schema, "$.additionalProperties", "variant")
        shut = (F.schema_of_variant(extra) == "BOOLEAN") & ~F.try_variant_get(schema, "$.additionalProperties", "boolean")
        required = F.size(F.try_variant_get(schema, "$.required", "array<variant>"))
        enums = let(
            F.map_values(F.try_variant_get(schema, "$.properties", "map<string,variant>")),
            lambda values: F.size(values)
            + F.aggregate(values, F.lit(0), lambda acc, v: acc + _count(F.size(F.try_variant_get(v, "$.enum", "array<variant>")))),
        )
        return F.when(F.coalesce(shut, F.lit(False)), 5).otherwise(0) + _count(required) * 3 + _count(enums)

    words = (
        occurrences(text, F.lit('"required"')) * 2
        + occurrences(text, F.lit('"enum"')) * 2
        + occurrences(text, F.lit("additionalProperties")) * 3
    )
    score = let(json_object(text), lambda schema: F.when(is_json_object(schema), parsed_score(schema)).otherwise(words))
    return F.coalesce(score, F.lit(0)).cast("int")


def _count(size: Column) -> Column:
    """Size of a list, 0 when there is none."""
    return F.coalesce(F.greatest(size, F.lit(0)), F.lit(0))


# Text blocks and role markers --------------------------------------------------------------------


def text_blocks(text: Column) -> Column:
    """Blocks between blank lines: original number, kind and text with the blank line kept."""
    parts = F.transform(F.split(text, "\n\n"), lambda p, i: F.struct(i.alias("no"), p.alias("part")))
    full = F.filter(parts, lambda p: strip(p["part"]) != "")

    def about(part: Column, cues: tuple[str, ...]) -> Column:
        plain = F.lower(part)
        hit = plain.contains(cues[0])
        for cue in cues[1:]:
            hit = hit | plain.contains(cue)
        return hit

    blocks = F.transform(
        full,
        lambda p: F.struct(
            p["no"].alias("no"),
            F.concat(F.lit("b"), p["no"].cast("string")).alias("block_id"),
            F.when(about(p["part"], OUTPUT_CUES), "output")
            .when(about(p["part"], EXAMPLE_CUES), "example")
            .when(about(p["part"], CONSTRAINT_CUES), "constraint")
            .otherwise("instruction")
            .alias("kind"),
            F.concat(p["part"], F.lit("\n\n")).alias("text"),
        ),
    )
    lone = F.array(F.struct(F.lit(0).alias("no"), F.lit("b0").alias("block_id"), F.lit("other").alias("kind"), F.coalesce(text, F.lit("")).alias("text")))
    return F.when(F.coalesce(F.size(blocks), F.lit(0)) > 0, blocks).otherwise(lone)


def replaced_block(old: Column, new: Column) -> Column:
    """New block text that keeps the trailing blank line of the old one."""
    keeps = old.endswith("\n\n") & ~new.endswith("\n\n")
    return F.when(new.isNull(), old).when(keeps, F.concat(F.regexp_replace(new, r"(?U)\s+$", ""), F.lit("\n\n"))).otherwise(new)


def marker(role: Column, index: Column, closing: bool = False) -> Column:
    return F.concat(F.lit("</ROLE::" if closing else "<ROLE::"), role, F.lit("::"), index.cast("string"), F.lit(">"))


def marked(role: Column, index: Column, text: Column) -> Column:
    """One message between its start and end marker."""
    return F.concat_ws("\n", marker(role, index), text, marker(role, index, closing=True))


def between_markers(text: Column, role: Column, index: Column) -> Column:
    """Text of one message in a merged block, NULL when a marker is missing."""
    opening, closing = marker(role, index), marker(role, index, closing=True)
    start = F.position(opening, text) + F.length(opening)
    stop = F.position(closing, text, start)
    return F.when((F.position(opening, text) > 0) & (stop > 0), strip(F.substr(text, start, stop - start)))

