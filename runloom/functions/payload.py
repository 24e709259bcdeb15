"""Reading schemaless run payloads held as VARIANT."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from runloom.functions.text import let, strip

# Status synonyms. The fine table tells timeouts, errors and cancellations apart, the
# coarse one knows only success and failure and leaves every other word as it is.
FINE_STATUS = {
    "success": ("success", "succeeded", "ok", "completed", "done"),
    "partial_success": ("partial_success", "partial-success", "partial"),
    "timeout": ("timeout", "timed_out", "time_out"),
    "failed": ("failed", "failure"),
    "error": ("error", "errored", "exception"),
    "canceled": ("canceled", "cancelled", "aborted"),
}
COARSE_STATUS = {
    "success": ("success", "succeeded", "ok", "completed", "done"),
    "failed": ("failed", "failure", "error", "errored", "exception"),
}
STATUS_KEYS = ("status", "state", "result")
STATUS_PLACES = ("$", "$.result", "$.result.data", "$.data")


def at(payload: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(payload, path, kind)


def truthy(text: Column) -> Column:
    """NULL for the text forms of empty values."""
    return F.when(~text.isin("", "{}", "[]", "0", "false"), text)


def synonym(text: Column, table: dict[str, Sequence[str]]) -> Column:
    """The name whose synonyms include ``text``, else NULL."""
    out = None
    for name, words in table.items():
        out = F.when(text.isin(*words), name) if out is None else out.when(text.isin(*words), name)
    return out


def normalize_status(text: Column) -> Column:
    plain = F.lower(strip(text))
    return F.coalesce(synonym(plain, FINE_STATUS), plain)


def status(payload: Column, table: dict[str, Sequence[str]], trim: bool) -> Column:
    """First recognised status among the known places, else the first word found.

    A payload that has an output and no status at all succeeded.
    """
    found = F.array_compact(F.array(*[at(payload, f"{place}.{key}") for place in STATUS_PLACES for key in STATUS_KEYS]))
    plain = F.transform(found, lambda s: F.lower(strip(s) if trim else s))

    def first_known(words: Column) -> Column:
        known = F.array_compact(F.transform(words, lambda s: synonym(s, table)))
        return F.coalesce(F.try_element_at(known, F.lit(1)), F.try_element_at(words, F.lit(1)))

    return F.coalesce(let(plain, first_known), F.when(at(payload, "$.output").isNotNull(), "success"), F.lit("unknown"))


def output_text(payload: Column, raw: Column) -> Column:
    """First of output, data, result, response; the ``text`` field of an object; else the raw payload."""
    parts = []
    for key in ("output", "data", "result", "response"):
        parts += [F.when(at(payload, f"$.{key}").isNotNull(), F.coalesce(at(payload, f"$.{key}.text"), at(payload, f"$.{key}")))]
    return F.coalesce(*parts, raw)


def workflow_input(payload: Column, raw: Column) -> Column:
    paths = ("input", "inputs", "workflow_input", "payload", "data.input", "data.inputs", "data.request")
    joined = F.concat_ws("\n", *[truthy(at(payload, f"$.{p}")) for p in paths])
    return F.coalesce(F.nullif(joined, F.lit("")), raw)


def metric(payload: Column, name: str, kind: str = "double") -> Column:
    """A number from ``metrics``, ``data.metrics`` or ``result.data.metrics``."""
    return F.coalesce(*[at(payload, f"{p}.metrics.{name}", kind) for p in ("$", "$.data", "$.result.data")])


def response_text(payload: Column) -> Column:
    """Text of a model response: text, content, output, or the first choice."""
    paths = ("$.text", "$.content", "$.output", "$.choices[0].message.content", "$.choices[0].text")
    return F.coalesce(*[truthy(at(payload, p)) for p in paths], F.lit(""))
