"""Queries over workflow definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.operators import dsl as D
from runloom.plans.registry import query
from runloom.sources.adapters import LOCATIONS_SQL, dsl_trees

WITH_LOC = f"WITH {LOCATIONS_SQL}"
MARKED = "'<ROLE::' || role || '::' || idx || '>' || chr(10) || text || chr(10) || '</ROLE::' || role || '::' || idx || '>'"
BLOCKS_SQL = f"""{WITH_LOC}, blk AS (
  SELECT doc_id, lang, source, node_id, bucket_no, node_no, string_agg({MARKED}, chr(10) ORDER BY message_no) AS merged_text, count(*) AS messages
  FROM loc GROUP BY ALL
)"""


def nodes(spark, folder):
    return D.dsl_nodes(dsl_trees(spark, folder), ["doc_id", "lang", "source"], "tree")


KEYS = ["doc_id", "lang", "source"]


@query(
    "extract_graph",
    f"""{WITH_LOC} SELECT doc_id, g AS pointer, 4 AS nodes FROM d""",
)
def extract_graph(spark, folder):
    graphs = dsl_trees(spark, folder).select("doc_id", D.extract_graph(F.col("tree")).alias("g"))
    count = F.size(F.try_variant_get(F.col("g.graph"), "$.nodes", "array<variant>"))
    return graphs.select("doc_id", "g.pointer", count.alias("nodes"))


@query("prompt_locations", f"{WITH_LOC} SELECT doc_id, node_id, path, text FROM loc")
def prompt_locations(spark, folder):
    return D.prompt_locations(nodes(spark, folder), KEYS).select("doc_id", "node_id", "path", "text")


@query("prompt_blocks", f"{BLOCKS_SQL} SELECT doc_id, node_id, messages, merged_text FROM blk")
def prompt_blocks(spark, folder):
    blocks = D.prompt_blocks(nodes(spark, folder), KEYS)
    return blocks.select("doc_id", "node_id", F.size("messages").cast("long").alias("messages"), "merged_text")


BRIEF_SQL = """CASE node_id
  WHEN 'a' THEN 'node_id: a' || chr(10) || 'name: Writer' || chr(10) || 'type: llm' || chr(10) || 'role: author' || chr(10) || 'input_schema keys: [''x'']'
    || chr(10) || 'output_schema keys: [''y'']' || chr(10) || 'message_layout: [{''role'': ''system'', ''index'': 0}, {''role'': ''user'', ''index'': 1}, {''role'': ''user'', ''index'': 2}]'
    || chr(10) || 'placeholders (do not change): [''{{ lang }}'']'
  WHEN 'b' THEN 'node_id: b' || chr(10) || 'name: Checker' || chr(10) || 'type: llm' || chr(10) || 'role: llm'
    || chr(10) || 'message_layout: [{''role'': ''user'', ''index'': 0}, {''role'': None, ''index'': 1}]' || chr(10) || 'placeholders (do not change): [''${' || source || '}'']'
  WHEN 'node_2' THEN 'node_id: node_2' || chr(10) || 'name: node_2' || chr(10) || 'type: code' || chr(10) || 'role: code' || chr(10) || 'message_layout: [{''role'': ''system'', ''index'': 0}]'
  ELSE 'node_id: e' || chr(10) || 'name: e' || chr(10) || 'type: ' || chr(10) || 'message_layout: [{''role'': ''system'', ''index'': 0}]' END"""


@query("node_brief", f"{BLOCKS_SQL} SELECT doc_id, node_id, {BRIEF_SQL} AS brief FROM blk")
def node_brief(spark, folder):
    blocks = D.prompt_blocks(nodes(spark, folder), KEYS)
    return blocks.select("doc_id", "node_id", D.brief_text(F.col("node_id"), F.col("brief")).alias("brief"))


@query(
    "block_context",
    f"""{BLOCKS_SQL} SELECT doc_id, node_id, 'Node brief:' || chr(10) || {BRIEF_SQL} || chr(10) || chr(10) || 'Failure signals:' || chr(10) || 'tags: ' || lang
  || chr(10) || chr(10) || 'Global constraints:' || chr(10) || '- Return JSON' || chr(10) || '- use ' || lang
  || CASE node_id WHEN 'a' THEN chr(10) || chr(10) || 'Placeholders (must remain exactly):' || chr(10) || '- {{{{ lang }}}}'
                  WHEN 'b' THEN chr(10) || chr(10) || 'Placeholders (must remain exactly):' || chr(10) || '- ${{' || source || '}}' ELSE '' END AS context
FROM blk""",
)
def block_context(spark, folder):
    blocks = D.prompt_blocks(nodes(spark, folder), KEYS)
    signal = F.concat(F.lit("tags: "), "lang")
    constraints = F.array(F.lit("Return JSON"), F.concat(F.lit("use "), "lang"))
    context = D.block_context(F.col("node_id"), F.col("brief"), signal, constraints)
    return blocks.select("doc_id", "node_id", context.alias("context"))


@query(
    "primary_message",
    f"""{WITH_LOC} SELECT doc_id, node_id, arg_min(path, (role <> 'system', message_no)) AS path FROM loc GROUP BY 1, 2""",
)
def primary_message(spark, folder):
    blocks = D.prompt_blocks(nodes(spark, folder), KEYS)
    return blocks.select("doc_id", "node_id", D.primary_message(F.col("messages"))["path"].alias("path"))


@query(
    "pointer_lookup",
    f"""{WITH_LOC} SELECT doc_id, path, text FROM loc UNION ALL SELECT doc_id, g || '/nodes/9/data', NULL FROM d""",
)
def pointer_lookup(spark, folder):
    trees = dsl_trees(spark, folder)
    paths = D.prompt_locations(nodes(spark, folder), KEYS).select("doc_id", "path")
    absent = trees.select("doc_id", F.concat(D.extract_graph(F.col("tree"))["pointer"], F.lit("/nodes/9/data")).alias("path"))
    asked = trees.select("doc_id", "tree").join(paths.unionByName(absent), "doc_id")
    return asked.select("doc_id", "path", D.pointer_lookup(F.col("tree"), F.col("path")).alias("text"))


PATCHED_SQL = """
WITH n AS (SELECT doc_id, '[{"data":{"inputs":{"x":1},"output_schema":{"y":1},"prompt_template":{"messages":[{"role":"system","text":"patched a"},{"role":"user"'
  || CASE WHEN text IS NULL THEN '' ELSE ',"text":' || CAST(to_json(text) AS VARCHAR) END || '},{"role":"user"}]},"role":"author","title":"Writer"},"id":"a","type":"llm"},'
  || '{"data":{"label":"Checker","prompt_template":[{"role":"user","text":' || CAST(to_json('second ' || lang) AS VARCHAR) || '},{"text":' || CAST(to_json(source) AS VARCHAR)
  || '},{},{"text":"third"}]},"id":"b","type":"llm"},{"data":{"system_prompt":' || CAST(to_json('sys ' || lang) AS VARCHAR) || '},"type":"code"},7]' AS nodes,
  '"new":{"0":{"text":"added"}}' AS added FROM documents)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '{"graph":{"nodes":' || nodes || '},' || added || '}'
  WHEN 1 THEN '{"graph":3,' || added || ',"workflow":{"graph":{"nodes":' || nodes || '}}}'
  ELSE '{"graph":{"data":[{"data":{"prompt_template":{"messages":[]}},"id":"d","type":"llm"},{"data":{"system_prompt":"tail"},"id":"e"}],"nodes":' || nodes || '},' || added || '}' END AS tree
FROM n"""


@query("patched_trees", PATCHED_SQL)
def patched_trees(spark, folder):
    """Whole definitions after patches of every document's tree: a message, a later patch of the same, a new list item, a new object."""
    trees = dsl_trees(spark, folder)
    graph = D.extract_graph(F.col("tree"))["pointer"]
    changes = F.array(
        F.struct(F.concat(graph, F.lit("/nodes/0/data/prompt_template/messages/0/text")).alias("path"), F.lit(1).alias("patch_no"), F.lit("patched a").alias("new")),
        F.struct(F.concat(graph, F.lit("/nodes/1/data/prompt_template/0/text")).alias("path"), F.lit(2).alias("patch_no"), F.lit("first").alias("new")),
        F.struct(F.concat(graph, F.lit("/nodes/1/data/prompt_template/0/text")).alias("path"), F.lit(3).alias("patch_no"), F.concat(F.lit("second "), "lang").alias("new")),
        F.struct(F.concat(graph, F.lit("/nodes/1/data/prompt_template/3/text")).alias("path"), F.lit(4).alias("patch_no"), F.lit("third").alias("new")),
        F.struct(F.lit("/new/0/text").alias("path"), F.lit(5).alias("patch_no"), F.lit("added").alias("new")),
    )
    patches = trees.select("doc_id", F.inline(changes))
    return D.patch_trees(trees, patches, ["doc_id"], "tree").select("doc_id", F.to_json("patched").alias("tree"))


@query(
    "apply_patches",
    f"""{WITH_LOC} SELECT doc_id, path, CASE WHEN node_id = 'b' AND message_no = 0 THEN 'second ' || lang ELSE text END AS text,
  node_id = 'b' AND message_no = 0 AS patched FROM loc
UNION ALL SELECT doc_id, '/graph/new/0/text', 'added', true FROM d""",
)
def apply_patches(spark, folder):
    leaves = D.prompt_locations(nodes(spark, folder), KEYS)
    target = leaves.where((F.col("node_id") == "b") & (F.col("message_no") == 0))
    changes = F.array(
        F.struct(F.col("path"), F.lit(2).alias("patch_no"), F.concat(F.lit("second "), "lang").alias("new")),
        F.struct(F.col("path"), F.lit(1).alias("patch_no"), F.lit("first").alias("new")),
        F.struct(F.lit("/graph/new/0/text").alias("path"), F.lit(3).alias("patch_no"), F.lit("added").alias("new")),
        F.struct(F.lit("no pointer").alias("path"), F.lit(4).alias("patch_no"), F.lit("ignored").alias("new")),
    )
    return D.apply_patches(leaves, target.select("doc_id", F.inline(changes)), ["doc_id"])


def rewritten_blocks(spark, folder):
    """Rewrites that improve node a, lose a placeholder of node b and lose a marker of the code node."""
    merged = F.col("merged_text")
    new = (
        F.when(F.col("node_id") == "a", F.replace(merged, F.lit("You write"), F.lit("Please write")))
        .when(F.col("node_id") == "b", F.replace(merged, F.lit("${"), F.lit("$ {")))
        .when(F.col("node_id") == "node_2", F.replace(merged, F.lit("</ROLE"), F.lit("<ROLE")))
        .otherwise(F.concat(merged, F.lit("\n")))
    )
    return D.prompt_blocks(nodes(spark, folder), KEYS).withColumn("rewritten", new)


@query(
    "diff_prompts",
    f"""{WITH_LOC} SELECT doc_id, node_id, path, text AS old, 'Please write ' || lang || ' {{{{ lang }}}}' AS new
FROM loc WHERE node_id = 'a' AND message_no = 0
UNION ALL SELECT doc_id, node_id, path, text, trim(replace(text, 'You write', 'Please write'), E' \\t\\n\\r') FROM loc
WHERE node_id = 'a' AND message_no = 1 AND contains(text, 'You write')""",
)
def diff_prompts(spark, folder):
    return D.diff_prompts(rewritten_blocks(spark, folder), ["doc_id"], "rewritten")


@query("order_patches", f"{WITH_LOC} SELECT doc_id, path, bucket_no, node_no, message_no FROM loc")
def order_patches(spark, folder):
    places = D.prompt_locations(nodes(spark, folder), KEYS)
    patches = places.select("doc_id", "path", F.concat(F.lit("new "), "text").alias("new"))
    ordered = D.order_patches(patches, places, ["doc_id"])
    return ordered.select("doc_id", "path", "bucket_no", "node_no", "message_no")
