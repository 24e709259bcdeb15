"""Text expressions built from Spark's own functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two placeholder forms, {{ name }} and ${name}.
BRACES = r"\{\{\s*[^{}]+\s*\}\}"
DOLLAR = r"\$\{\s*[^${}]+\s*\}"
EDGE_SPACE = r"(?U)^\s+|\s+$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; keeps nested expressions from repeating it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Drop white space at both ends, Unicode spaces included."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def non_empty(text: Column) -> Column:
    return F.coalesce(F.length(text) > 0, F.lit(False))


def placeholders(text: Column) -> Column:
    """Distinct ``{{..}}`` tokens in order, then distinct ``${..}`` tokens."""
    found = F.concat(
        F.regexp_extract_all(text, F.lit(BRACES), F.lit(0)), F.regexp_extract_all(text, F.lit(DOLLAR), F.lit(0))
    )
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(found))


def occurrences(text: Column, token: Column) -> Column:
    """How often ``token`` occurs in ``text`` without overlap."""
    return ((F.length(text) - F.length(F.replace(text, token, F.lit("")))) / F.length(token)).cast("int")


def mask_token(index: Column) -> Column:
    return F.concat(F.lit("<<<PH_"), index.cast("string"), F.lit(">>>"))


def _fold_tokens(text: Column, tokens: Column, step) -> Column:
    numbered = F.transform(tokens, lambda t, i: F.struct(i.alias("i"), t.alias("t")))
    return F.aggregate(numbered, text, lambda acc, e: step(acc, mask_token(e["i"]), e["t"]))


def mask_placeholders(text: Column, tokens: Column) -> Column:
    return _fold_tokens(text, tokens, lambda acc, mask, token: F.replace(acc, token, mask))


def restore_placeholders(text: Column, tokens: Column) -> Column:
    return _fold_tokens(text, tokens, lambda acc, mask, token: F.replace(acc, mask, token))


def tokens_intact(before: Column, after: Column, tokens: Column) -> Column:
    """Every mask token occurs equally often in both texts."""
    positions = F.transform(tokens, lambda t, i: mask_token(i))
    return F.forall(positions, lambda m: occurrences(before, m) == occurrences(after, m))


def placeholders_preserved(tokens: Column, text: Column) -> Column:
    return F.array_sort(tokens) == F.array_sort(placeholders(text))


# The markers around a message, what stands for them in a masked text, and the lines of a workflow's context.
ROLE_MARKER = r"</?ROLE::[^>]+::\d+>"
MARKER_TOKEN = r"\[\[ROLE_MARKER_(\d+)\]\]"
CONTEXT_NAME, CONTEXT_DESCRIPTION = "Workflow Name:", "Workflow Description:"


def marker_token(index: Column) -> Column:
    return F.concat(F.lit("[[ROLE_MARKER_"), index.cast("string"), F.lit("]]"))


def role_markers(text: Column) -> Column:
    """The markers around messages in their order, equal ones as often as they occur."""
    return F.regexp_extract_all(text, F.lit(f"({ROLE_MARKER})"), F.lit(1))


def mask_role_markers(text: Column) -> Column:
    """``text`` with a numbered token in place of each marker, by its position."""
    pieces = F.split(text, ROLE_MARKER, -1)
    last = F.size(pieces) - 1
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i < last, F.concat(p, marker_token(i))).otherwise(p)), "")


def restore_role_markers(text: Column, markers: Column) -> Column:
    """``text`` with the markers in place of their tokens, in one pass; tokens without a marker stay."""
    numbers = F.regexp_extract_all(text, F.lit(MARKER_TOKEN), F.lit(1))
    pieces = F.split(text, MARKER_TOKEN, -1)
    last = F.size(pieces) - 1

    def joined(found: Column) -> Column:
        def back(i: Column) -> Column:
            number = F.get(found, i)
            return F.coalesce(F.get(markers, number.try_cast("int")), F.concat(F.lit("[[ROLE_MARKER_"), number, F.lit("]]")))

        return F.array_join(F.transform(pieces, lambda p, i: F.when(i < last, F.concat(p, back(i))).otherwise(p)), "")

    return let(numbers, joined)


def role_markers_kept(text: Column, markers: Column) -> Column:
    """Whether every marker's token is in the text, at least once."""
    return F.forall(F.transform(markers, lambda m, i: marker_token(i)), lambda token: text.contains(token))


def workflow_context(text: Column) -> Column:
    """Struct of name and description from the lines of a context; the last line of each kind counts, NULL without one."""
    own = F.transform(F.split(strip(text), "\n"), strip)

    def after(label: str, among: Column) -> Column:
        last = F.try_element_at(F.filter(among, lambda line: line.startswith(label)), F.lit(-1))
        return strip(F.substring(last, F.lit(len(label) + 1), F.length(last)))

    return let(own, lambda lines_: F.struct(after(CONTEXT_NAME, lines_).alias("name"), after(CONTEXT_DESCRIPTION, lines_).alias("description")))


def coerced_text(value: Column) -> Column:
    """A VARIANT as text: nothing as the empty text, texts as they are, lists and objects as compact JSON, True and False by name."""
    plain = F.try_variant_get(value, "$", "string")
    kind = F.schema_of_variant(value)
    written = (
        F.when(kind == "BOOLEAN", F.initcap(plain)).when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.to_json(value)).otherwise(plain)
    )
    return F.when(value.isNull() | F.is_variant_null(value), F.lit("")).otherwise(F.coalesce(written, F.lit("")))


def yes_or_no(answer: Column, otherwise: Column) -> Column:
    """True for an answer that holds yes and not no, false for the reverse, else what ``otherwise`` says."""
    low = F.lower(answer)
    yes, no = low.contains("yes"), low.contains("no")
    return F.when(yes & ~no, True).when(no & ~yes, False).otherwise(otherwise)


def keywords(text: Column) -> Column:
    """Distinct lower-case ASCII words of three or more characters."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3))


def prompt_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def draw_order(seed: int, *keys: Column | str) -> Column:
    """Repeatable pseudo-random order of rows: a digest of seed and keys."""
    texts = [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *texts))


def lines(text: Column) -> Column:
    return F.split(text, "\r\n|\r|\n")


def bullets(text: Column) -> Column:
    """Non-empty lines without one leading dash."""
    stripped = F.transform(lines(text), strip)
    undashed = F.transform(stripped, lambda s: strip(F.regexp_replace(s, "^-", "")))
    found = F.filter(undashed, lambda s: s != "")
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(found)


def rule_pairs(text: Column) -> Column:
    """Bullets of the form ``key: value`` as structs."""
    pairs = F.transform(
        F.filter(bullets(text), lambda b: b.contains(":")),
        lambda b: F.struct(
            strip(F.substring_index(b, ":", 1)).alias("key"),
            strip(F.regexp_replace(b, r"(?s)^[^:]*:", "")).alias("value"),
        ),
    )
    return F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != ""))


def rules_of(pairs: Column) -> Column:
    """Entries in order of first mention; the last value of a key wins."""
    return F.transform(
        F.array_distinct(F.transform(pairs, lambda p: p["key"])),
        lambda k: F.struct(
            k.alias("key"), F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"].alias("value")
        ),
    )


def json_object(text: Column) -> Column:
    """VARIANT of the whole text, else of the part from the first ``{`` to the last ``}``."""
    return F.coalesce(
        F.try_parse_json(text), F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")))
    )


def is_json_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
