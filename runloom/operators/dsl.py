"""Workflow definitions held as VARIANT trees: nodes, prompts, pointers and patches.

A tree is one row, so reading it needs no shuffle: nodes and messages come from arrays of that row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions import prompts as P
from runloom.functions import text as T
from runloom.functions.payload import at, truthy

BUCKETS = ("nodes", "data")


def _inner(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _list(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "array<variant>")


def extract_graph(tree: Column) -> Column:
    """Struct of the graph object and its pointer: the root ``graph``, else ``workflow.graph``."""
    root, nested = _inner(tree, "$.graph"), _inner(tree, "$.workflow.graph")
    own = T.is_json_object(root)
    return F.struct(
        F.when(own, root).when(T.is_json_object(nested), nested).alias("graph"),
        F.when(~own & T.is_json_object(nested), "/workflow/graph").otherwise("/graph").alias("pointer"),
    )


def dsl_nodes(trees: DataFrame, keys: Sequence[str], tree: str) -> DataFrame:
    """One row per node: its id, VARIANT value, pointer and place in the tree."""
    parsed = trees.select(*keys, extract_graph(F.col(tree)).alias("_g"))

    def bucket(number: int, name: str) -> Column:
        return F.transform(
            _list(F.col("_g.graph"), f"$.{name}"),
            lambda n, i: F.struct(
                F.lit(number).alias("bucket_no"),
                i.alias("node_no"),
                F.coalesce(truthy(at(n, "$.id")), F.concat(F.lit("node_"), i.cast("string"))).alias("node_id"),
                F.concat(F.col("_g.pointer"), F.lit(f"/{name}/"), i.cast("string")).alias("node_pointer"),
                n.alias("node"),
            ),
        )

    buckets = F.flatten(F.array_compact(F.array(*[bucket(i, b) for i, b in enumerate(BUCKETS)])))
    return parsed.select(*keys, F.inline(buckets)).where(T.is_json_object(F.col("node")))


def with_messages(nodes: DataFrame) -> DataFrame:
    """Add ``messages``: role, index, text and pointer of every prompt text of a node.

    Messages come from ``prompt_template`` (a list, or an object with ``messages``); a ``system_prompt``
    follows as one more message.
    """
    node = F.col("node")
    listed = _list(node, "$.data.prompt_template")
    nested = _list(node, "$.data.prompt_template.messages")
    base = F.concat(F.col("node_pointer"), F.lit("/data/prompt_template/"))
    staged = nodes.withColumns(
        {
            "_raw": F.coalesce(listed, nested, F.array().cast("array<variant>")),
            "_base": F.when(listed.isNull(), F.concat(base, F.lit("messages/"))).otherwise(base),
            "_system": at(node, "$.data.system_prompt"),
        }
    )
    every = F.transform(
        "_raw",
        lambda m, i: F.struct(
            i.alias("index"),
            F.coalesce(truthy(at(m, "$.role")), F.lit("user")).alias("role"),
            at(m, "$.text").alias("text"),
            F.concat(F.col("_base"), i.cast("string"), F.lit("/text")).alias("path"),
        ),
    )
    kept = F.filter(every, lambda m: m["text"].isNotNull())
    system = F.array(
        F.struct(
            F.size("_kept").alias("index"),
            F.lit("system").alias("role"),
            F.col("_system").alias("text"),
            F.concat("node_pointer", F.lit("/data/system_prompt")).alias("path"),
        )
    )
    return (
        staged.withColumn("_kept", kept)
        .withColumn("messages", F.when(F.col("_system").isNull(), F.col("_kept")).otherwise(F.concat("_kept", system)))
        .drop("_kept", "_base", "_system")
    )


def prompt_locations(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per prompt text with its pointer and order in the tree."""
    return with_messages(nodes).select(
        *keys, "bucket_no", "node_no", "node_id", F.posexplode("messages").alias("message_no", "_m")
    ).select(*keys, "bucket_no", "node_no", "node_id", "message_no", "_m.path", "_m.role", "_m.text")


def prompt_blocks(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per node with prompts: its messages, merged text and brief.

    Nodes without prompts yield no row of the inline; a filter would be pushed down and read the tree twice.
    """

    def block(messages: Column) -> Column:
        merged = F.array_join(F.transform(messages, lambda m: P.marked(m["role"], m["index"], m["text"])), "\n")
        return F.when(F.size(messages) > 0, F.array(F.struct(messages.alias("messages"), merged.alias("merged_text"))))

    places = (*keys, "bucket_no", "node_no", "node_id")
    found = with_messages(nodes).select(*places, "node", "_raw", F.inline(T.let(F.col("messages"), block)))
    brief = node_brief(F.col("node"), F.col("node_id"), F.col("_raw"), F.col("merged_text"))
    return found.select(*places, "messages", "merged_text", brief.alias("brief"))


def _keys_of(value: Column, path: str) -> Column:
    inner = _inner(value, path)
    return F.coalesce(F.when(T.is_json_object(inner), F.json_object_keys(F.to_json(inner))), F.array().cast("array<string>"))


def node_brief(node: Column, node_id: Column, raw_messages: Column, merged_text: Column) -> Column:
    """Name, type, role, schema keys, message layout and placeholders of a node."""
    kind = F.coalesce(truthy(at(node, "$.type")), F.lit(""))
    layout = F.transform(
        raw_messages, lambda m, i: F.struct(at(m, "$.role").alias("role"), i.alias("index"))
    )
    system = F.array(F.struct(F.lit("system").alias("role"), F.size(raw_messages).alias("index")))
    return F.struct(
        F.coalesce(truthy(at(node, "$.data.title")), truthy(at(node, "$.data.label")), node_id).alias("name"),
        kind.alias("type"),
        F.coalesce(truthy(at(node, "$.data.role")), truthy(at(node, "$.data.description")), kind).alias("role"),
        _keys_of(node, "$.data.inputs").alias("input_keys"),
        _keys_of(node, "$.data.output_schema").alias("output_keys"),
        F.when(at(node, "$.data.system_prompt").isNotNull(), F.concat(layout, system)).otherwise(layout).alias("layout"),
        T.placeholders(merged_text).alias("placeholders"),
    )


def brief_text(node_id: Column, brief: Column) -> Column:
    """Brief as ``label: value`` lines; empty facts are left out."""
    def fact(label: str, items: Column, shown: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(f"{label}: "), shown))

    slots = F.transform(
        brief["layout"],
        lambda s: F.concat(
            F.lit("{'role': "), F.coalesce(F.concat(F.lit("'"), s["role"], F.lit("'")), F.lit("None")),
            F.lit(", 'index': "), s["index"].cast("string"), F.lit("}"),
        ),
    )
    return F.concat_ws(
        "\n",
        F.concat(F.lit("node_id: "), node_id),
        F.concat(F.lit("name: "), brief["name"]),
        F.concat(F.lit("type: "), brief["type"]),
        F.when(brief["role"] != "", F.concat(F.lit("role: "), brief["role"])),
        fact("input_schema keys", brief["input_keys"], P.listed(brief["input_keys"])),
        fact("output_schema keys", brief["output_keys"], P.listed(brief["output_keys"])),
        fact("message_layout", brief["layout"], F.concat(F.lit("["), F.array_join(slots, ", "), F.lit("]"))),
        fact("placeholders (do not change)", brief["placeholders"], P.listed(brief["placeholders"])),
    )


def block_context(node_id: Column, brief: Column, signal: Column, constraints: Column) -> Column:
    """Brief, failure signals, constraints and placeholders of a node as one text."""
    def section(title: str, items: Column) -> Column:
        lines = F.transform(items, lambda i: F.concat(F.lit("- "), i))
        return F.when(F.size(items) > 0, F.concat(F.lit(f"\n{title}:\n"), F.array_join(lines, "\n")))

    return F.concat_ws(
        "\n",
        F.lit("Node brief:"),
        brief_text(node_id, brief),
        F.lit("\nFailure signals:"),
        F.coalesce(signal, F.lit("")),
        section("Global constraints", constraints),
        section("Placeholders (must remain exactly)", brief["placeholders"]),
    )


def primary_message(messages: Column) -> Column:
    """The first system message, else the first message."""
    system = F.filter(messages, lambda m: F.lower(m["role"]) == "system")
    return F.coalesce(F.try_element_at(system, F.lit(1)), F.try_element_at(messages, F.lit(1)))


def pointer_path(pointer: Column) -> Column:
    """Variant path of a JSON pointer: numbers are list positions, everything else is a key."""
    parts = F.filter(F.split(pointer, "/"), lambda p: p != "")
    steps = F.transform(
        parts,
        lambda p: F.when(p.rlike("^[0-9]+$"), F.concat(F.lit("["), p, F.lit("]"))).otherwise(
            F.concat(F.lit("['"), p, F.lit("']"))
        ),
    )
    return F.concat(F.lit("$"), F.array_join(steps, ""))


def pointer_lookup(tree: Column, pointer: Column, kind: str = "string") -> Column:
    """Value at a pointer, NULL when the tree has none."""
    return F.when(pointer.startswith("/"), F.try_variant_get(tree, pointer_path(pointer), kind))


# Patches -----------------------------------------------------------------------------------------


def apply_patches(leaves: DataFrame, patches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Prompt texts after the patches: the last patch of a pointer wins, new pointers are added.

    ``leaves`` has the keys, ``path`` and ``text``; ``patches`` has the keys, ``path``, ``patch_no`` and
    ``new``. The old texts stay in ``leaves``.
    """
    latest = patches.where(F.col("path").startswith("/")).groupBy(*keys, "path").agg(F.max_by("new", "patch_no").alias("_new"))
    return leaves.select(*keys, "path", "text").join(latest, [*keys, "path"], "full").select(
        *keys, "path", F.coalesce("_new", "text").alias("text"), F.col("_new").isNotNull().alias("patched")
    )


def _json_text(value: Column) -> Column:
    return F.to_json(value.cast("variant"))


def _rest(patches: Column, mine: Callable[[Column], Column]) -> Column:
    """The patches that go on to one child, without the step that leads there."""
    return F.transform(
        F.filter(patches, lambda p: mine(p["parts"][0])),
        lambda p: F.struct(F.slice(p["parts"], F.lit(2), F.greatest(F.size(p["parts"]) - 1, F.lit(0))).alias("parts"), p["new"].alias("new")),
    )


def _children(items: Column, entries: Column, patches: Column) -> Column:
    """Name, value and patches of each child after the patches: of a list by position, of an object, or of a new object, by key.

    A list grows as far as the highest position asked for; NULL if a step into a list is no position.
    """
    steps = F.transform(patches, lambda p: F.when(p["parts"][0].rlike("^[0-9]+$"), p["parts"][0].cast("int")))
    size = F.greatest(F.size(items), F.array_max(steps) + 1)
    listed = F.transform(
        F.slice(F.sequence(F.lit(0), size), F.lit(1), size),
        lambda i: F.struct(i.cast("string").alias("name"), F.get(items, i).alias("value"), _rest(patches, lambda step: step.cast("int") == i).alias("patches")),
    )
    keys = F.coalesce(F.map_keys(entries), F.array().cast("array<string>"))
    names = F.array_distinct(F.concat(keys, F.transform(patches, lambda p: p["parts"][0])))
    keyed = F.transform(
        names, lambda n: F.struct(n.alias("name"), F.try_element_at(entries, n).alias("value"), _rest(patches, lambda step: step == n).alias("patches"))
    )
    return F.when(items.isNull(), keyed).when(F.forall(steps, lambda i: i.isNotNull()), listed)


def _opened(row: Column) -> Column:
    """What a piece of a walk becomes: itself, if it is text, or the text of a value, or the pieces of a container that patches lie below."""
    below = F.filter(row["patches"], lambda p: F.size(p["parts"]) > 0)
    own = F.filter(row["patches"], lambda p: F.size(p["parts"]) == 0)

    def piece(value: Column, patches: Column, text: Column) -> Column:
        return F.struct(value.alias("value"), patches.alias("patches"), text.cast("string").alias("text"))

    def written(text: Column) -> Column:
        none = F.array().cast("array<struct<parts:array<string>,new:string>>")
        return piece(F.lit(None).cast("variant"), none, text)

    # what a patch has replaced is a text, so a deeper patch starts with a new object there
    kept = F.when(F.size(own) == 0, row["value"])
    parts = F.struct(_list(kept, "$").alias("items"), F.try_variant_get(kept, "$", "map<string,variant>").alias("entries"), below.alias("below"))

    def opened(found: Column) -> Column:
        listed = found["items"].isNotNull()

        def child(c: Column, i: Column) -> Column:
            name = F.when(~listed, F.concat(_json_text(c["name"]), F.lit(":"))).otherwise(F.lit(""))
            lead = written(F.concat(F.when(i == 0, "").otherwise(","), name))
            untouched = F.size(c["patches"]) == 0
            whole = written(F.coalesce(F.to_json(c["value"]), F.lit("{}")))
            return F.array(lead, F.when(untouched, whole).otherwise(piece(c["value"], c["patches"], F.lit(None))))

        def between(every: Column) -> Column:
            start, end = (F.array(written(F.when(listed, a).otherwise(b))) for a, b in (("[", "{"), ("]", "}")))
            return F.concat(start, F.flatten(F.transform(every, child)), end)

        return T.let(_children(found["items"], found["entries"], found["below"]), between)

    return (
        F.when(F.size(row["patches"]) == 0, F.array(row))
        .when(F.size(below) == 0, F.array(written(_json_text(F.get(own, F.lit(0))["new"]))))
        .otherwise(F.coalesce(T.let(parts, opened), F.array(written(F.lit(None)))))
    )


def _last_patches(gathered: Column) -> Column:
    """Of the gathered patches of each pointer the last, as the steps that lead there and the new text."""
    steps = lambda p: F.filter(F.split(p["path"], "/"), lambda step: step != "")
    entry = lambda p: F.struct(steps(p).alias("parts"), p["patch_no"].alias("patch_no"), F.when(p["patch_no"].isNotNull(), p["new"]).alias("new"))

    def last(ranked: Column) -> Column:
        kept = F.filter(ranked, lambda p, i: ~F.coalesce(F.get(ranked, i + 1)["parts"] == p["parts"], F.lit(False)))
        return F.transform(kept, lambda p: F.struct(p["parts"].alias("parts"), p["new"].alias("new")))

    return T.let(F.sort_array(F.transform(gathered, entry)), last)


def patch_trees(trees: DataFrame, patches: DataFrame, keys: Sequence[str], tree: str) -> DataFrame:
    """``trees`` with ``patched``: the whole definition as VARIANT after its patches; ``tree`` stays as it is.

    ``patches`` has the keys, which identify a definition, ``path``, ``patch_no`` and ``new``. The last patch of a pointer
    wins; one below another pointer that is patched wins over it. Steps that lead nowhere make objects, also if they are numbers;
    in a list that is there, a number is a position, and positions left out up to it are filled with empty objects. Paths
    without a leading slash change nothing. A step into a list that is no position, or a pointer without steps, gives no
    patched definition (NULL). Rows of ``trees`` that share their keys are patched each on its own.

    A definition is one row and meets its patches in one join. It is written in pieces, in their order: only containers on a
    patched path are opened, a level at a time, as many as the row's longest pointer has steps; subtrees without a
    patch are one piece of JSON. The pieces joined are the patched definition, so that nothing is dealt out again.
    """
    keys = list(keys)
    entry = F.struct("path", "patch_no", "new")
    gathered = patches.where(F.col("path").startswith("/")).groupBy(*keys).agg(F.collect_list(entry).alias("_entries"))
    joined = trees.join(gathered, keys, "left")

    def walked(last: Column) -> Column:
        whole = F.array(F.struct(F.col(tree).alias("value"), last.alias("patches"), F.lit(None).cast("string").alias("text")))
        levels = F.sequence(F.lit(0), F.array_max(F.transform(last, lambda p: F.size(p["parts"]))))
        pieces = F.aggregate(levels, whole, lambda found, _: F.flatten(F.transform(found, _opened)))
        text = T.let(pieces, lambda found: F.when(F.forall(found, lambda p: p["text"].isNotNull()), F.array_join(F.transform(found, lambda p: p["text"]), "")))
        return F.when(F.forall(last, lambda p: F.size(p["parts"]) > 0), text)

    text = T.let(_last_patches(F.col("_entries")), walked)
    patched = F.when(F.col("_entries").isNotNull(), F.parse_json(text)).otherwise(F.col(tree))
    return joined.select(*trees.columns, patched.alias("patched"))


def diff_prompts(blocks: DataFrame, keys: Sequence[str], rewritten: str) -> DataFrame:
    """Patches of rewritten blocks: one per message whose stripped text changed.

    A rewrite that lost a marker, or lost or gained a placeholder, gives no patches at all.
    """

    def message_patches(new: Column) -> Column:
        return F.transform(
            "messages",
            lambda m: F.struct(
                m["path"].alias("path"), m["text"].alias("old"), P.between_markers(new, m["role"], m["index"]).alias("new")
            ),
        )

    def block_patches(new: Column) -> Column:
        changed = T.strip(new) != T.strip(F.col("merged_text"))
        sound = T.placeholders_preserved(F.col("brief.placeholders"), new)
        kept = T.let(
            message_patches(new),
            lambda found: F.when(
                F.forall(found, lambda m: m["new"].isNotNull()),
                F.filter(found, lambda m: T.strip(m["new"]) != T.strip(m["old"])),
            ),
        )
        return F.when(changed & sound, kept)

    return blocks.select(*keys, "node_id", F.inline(T.let(F.col(rewritten), block_patches)))


def order_patches(patches: DataFrame, locations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Patches with their place in the tree, sorted by node and then by message."""
    places = locations.select(*keys, "path", "bucket_no", "node_no", "message_no")
    return patches.join(places, [*keys, "path"]).orderBy(*keys, "bucket_no", "node_no", "message_no")
