"""Queries over prompts, outputs and judge answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.functions import payload as PL
from runloom.functions import prompts as P
from runloom.functions import text as T
from runloom.operators import texts as X
from runloom.plans.registry import query
from runloom.sources import adapters as A
from runloom.sources.adapters import SPECS_SQL, TEXT_RUNS_SQL, table

PLACEHOLDER_SQL = "text || ' {{ ' || lang || ' }} ${' || source || '} {{ ' || lang || ' }} {{a.b}}'"


def tokenized(spark, folder):
    """Document texts with placeholders appended, as the given texts hold none."""
    tail = F.concat(
        F.lit(" {{ "), "lang", F.lit(" }} ${"), "source", F.lit("} {{ "), "lang", F.lit(" }} {{a.b}}")
    )
    return table(spark, folder, "documents").select("doc_id", "lang", "source", F.concat("text", tail).alias("text"))


@query(
    "extract_placeholders",
    """SELECT doc_id, '{{ ' || lang || ' }},{{a.b}},${' || source || '}' AS placeholders FROM documents""",
)
def extract_placeholders(spark, folder):
    found = T.placeholders(F.col("text"))
    return tokenized(spark, folder).select("doc_id", F.array_join(found, ",").alias("placeholders"))


@query(
    "guard_rewrite",
    f"""WITH d AS (SELECT *, {PLACEHOLDER_SQL} AS t FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'New ' || t || ' end' ELSE t END AS guarded FROM d""",
)
def guard_rewrite(spark, folder):
    rows = tokenized(spark, folder)
    key = F.col("doc_id")
    plain = F.regexp_replace("text", r"(?s) \{\{ [a-z]+ \}\} \$\{.*$", "")
    good = F.concat(F.lit("New "), plain, F.lit(" <<<PH_0>>> <<<PH_2>>> <<<PH_0>>> <<<PH_1>>> end"))
    rewritten = (
        F.when(key % 4 == 0, good)
        .when(key % 4 == 1, F.replace(good, F.lit("<<<PH_2>>>"), F.lit("")))  # a lost token
        .when(key % 4 == 2, F.concat(good, F.lit("<<<PH_1>>>")))  # a doubled token
        .otherwise(F.concat(good, F.lit(" {{ extra }}")))  # a placeholder that was not there
    )
    return X.guard_rewrite(rows.withColumn("rewritten", rewritten), "text", "rewritten").select("doc_id", "guarded")


@query(
    "mask_role_markers",
    """SELECT doc_id, '[[ROLE_MARKER_0]]' || chr(10) || text || chr(10) || '[[ROLE_MARKER_1]]' || chr(10) || '[[ROLE_MARKER_2]]' || lang || '[[ROLE_MARKER_3]]' AS masked,
  CASE doc_id % 3 WHEN 0 THEN '<ROLE::system::0>' || chr(10) || 'new ' || lang || chr(10) || '</ROLE::system::0>' || chr(10) || '<ROLE::user::1>' || lang || '</ROLE::user::1>'
  ELSE '<ROLE::system::0>' || chr(10) || text || chr(10) || '</ROLE::system::0>' || chr(10) || '<ROLE::user::1>' || lang || '</ROLE::user::1>' END AS guarded FROM documents""",
)
def mask_role_markers(spark, folder):
    """Blocks with their markers masked, and rewrites that keep, lose or garble a marker."""
    text = F.concat(F.lit("<ROLE::system::0>\n"), "text", F.lit("\n</ROLE::system::0>\n<ROLE::user::1>"), "lang", F.lit("</ROLE::user::1>"))
    docs = table(spark, folder, "documents").select("doc_id", "lang", text.alias("block"))
    key, masked = F.col("doc_id"), T.mask_role_markers(F.col("block"))
    new = F.concat(F.lit("[[ROLE_MARKER_0]]\nnew "), "lang", F.lit("\n[[ROLE_MARKER_1]]\n[[ROLE_MARKER_2]]"), "lang", F.lit("[[ROLE_MARKER_3]]"))
    lost = F.replace(new, F.lit("[[ROLE_MARKER_1]]"), F.lit(""))
    garbled = F.replace(new, F.lit("[[ROLE_MARKER_3]]"), F.lit("[[ROLE_MARKER_33]]"))
    rows = docs.withColumns({"masked": masked, "rewritten": F.when(key % 3 == 0, new).when(key % 3 == 1, lost).otherwise(garbled)})
    return X.guard_rewrite(rows, "block", "rewritten").select("doc_id", "masked", "guarded")


@query(
    "workflow_context",
    """SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN source END AS name, CASE WHEN doc_id % 4 <> 1 THEN 'about ' || lang END AS description FROM documents""",
)
def workflow_context(spark, folder):
    key = F.col("doc_id")
    name = F.when(key % 4 != 0, F.concat(F.lit("  Workflow Name:  "), "source", F.lit(" \n")))
    about = F.when(key % 4 != 1, F.concat(F.lit("Workflow Description: first\n\tWorkflow Description: about "), "lang"))
    text = F.concat(F.lit("\n"), F.coalesce(name, F.lit("Workflow: none\n")), F.coalesce(about, F.lit("")))
    found = table(spark, folder, "documents").select("doc_id", T.workflow_context(text).alias("c"))
    return found.select("doc_id", "c.name", "c.description")


@query(
    "coerce_text",
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN lang WHEN 1 THEN '{"lang":"' || lang || '","list":[1,2]}' WHEN 2 THEN 'True' WHEN 3 THEN '' ELSE '' || doc_id END AS text FROM documents""",
)
def coerce_text(spark, folder):
    key = F.col("doc_id")
    quoted = F.concat(F.lit('"'), "lang", F.lit('"'))
    raw = (
        F.when(key % 5 == 0, quoted).when(key % 5 == 1, F.concat(F.lit('{"list":[1, 2], "lang": '), quoted, F.lit("}"))).when(key % 5 == 2, "true").when(key % 5 == 3, "null")
        .otherwise(key.cast("string"))
    )
    return table(spark, folder, "documents").select("doc_id", T.coerced_text(F.try_parse_json(raw)).alias("text"))


@query(
    "yes_no_verdict",
    """SELECT doc_id, CASE WHEN contains(lower(text), 'yes') AND NOT contains(lower(text), 'no') THEN true WHEN contains(lower(text), 'no') AND NOT contains(lower(text), 'yes') THEN false
  ELSE doc_id % 2 = 0 END AS wanted FROM documents""",
)
def yes_no_verdict(spark, folder):
    verdict = T.yes_or_no(F.col("text"), F.col("doc_id") % 2 == 0)
    return table(spark, folder, "documents").select("doc_id", verdict.alias("wanted"))


def paired(spark, folder):
    """Outputs next to the first expected output of their workflow."""
    specs = A.reference_specs(spark, folder)
    expected = specs.select("workflow_id", F.element_at("expected_outputs", 1).alias("expected"))
    outputs = table(spark, folder, "documents").select(
        F.concat(F.lit("wf_"), "source").alias("workflow_id"), F.col("doc_id").alias("index"), F.col("text").alias("output_text")
    )
    return outputs.join(expected, "workflow_id")


@query("similarity")
def similarity(spark, folder):
    scored = X.with_similarity(paired(spark, folder), "expected", "output_text")
    return scored.select("workflow_id", "index", F.round("similarity", 6).alias("similarity"))


@query("soft_reference_match")
def soft_reference_match(spark, folder):
    matched = X.soft_reference_match(paired(spark, folder), "expected", "output_text")
    return matched.select("workflow_id", "index", "matches")


@query(
    "skip_for_intent",
    f"""WITH {SPECS_SQL}, {TEXT_RUNS_SQL}, w AS (
  SELECT workflow_id, unnest(list_distinct(list_filter(regexp_extract_all(lower('the  Return JSON zq' || item_id || ' ' || expected), '[a-z0-9_]+'), lambda x: length(x) >= 3))) AS kw FROM specs
), kws AS (SELECT workflow_id, list(DISTINCT kw) AS k FROM w GROUP BY 1),
o AS (SELECT s."index", k, list_distinct(list_filter(regexp_extract_all(lower(output_text), '[a-z0-9_]+'), lambda x: length(x) >= 3)) AS own
      FROM samples s JOIN kws USING (workflow_id)),
c AS (SELECT "index", len(k) AS n, len(own) AS m, len(list_intersect(k, own)) AS overlap FROM o)
SELECT "index", CASE WHEN n = 0 THEN false WHEN m = 0 THEN true ELSE overlap / CAST(n AS DOUBLE) < 0.15 AND overlap <= 1 END AS skipped FROM c""",
)
def skip_for_intent(spark, folder):
    specs = A.reference_specs(spark, folder)
    joined = A.text_runs(spark, folder).join(specs, "workflow_id")
    skipped = X.skip_for_intent(F.col("output_text"), F.col("constraints"), F.col("expected_outputs"))
    return joined.select("index", skipped.alias("skipped"))


@query(
    "constraint_coverage",
    f"""WITH {SPECS_SQL}, {TEXT_RUNS_SQL}, c AS (
  SELECT workflow_id, unnest(['the ', 'Return JSON', 'zq' || item_id]) AS "constraint" FROM specs)
SELECT workflow_id, "constraint", count(*) AS runs, count(*) FILTER (contains(lower(output_text), lower("constraint"))) AS found
FROM samples JOIN c USING (workflow_id) GROUP BY 1, 2""",
)
def constraint_coverage(spark, folder):
    covered = X.constraint_coverage(A.text_runs(spark, folder), A.reference_specs(spark, folder))
    return covered.drop("constraint_no")


# Structured prompts around the document texts. Documents hold no header lines of their own.
STRICT_SQL = "CAST(doc_id % 8 AS VARCHAR)"
SECTION_ROWS_SQL = f"""
d AS (SELECT *, trim(text, E' \\t\\n\\r') AS body FROM documents WHERE doc_id % 3 <> 0),
sect AS (
  SELECT doc_id, 'role' AS section, 'You write ' || lang AS body FROM d
  UNION ALL SELECT doc_id, 'task', body FROM d
  UNION ALL SELECT doc_id, 'global_constraints', '- Return JSON' || chr(10) || '- use ' || lang FROM d
  UNION ALL SELECT doc_id, 'checkpoint_rules', '- tone: calm' || chr(10) || '- source: ' || source || chr(10) || '- tone: warm' FROM d
  UNION ALL SELECT doc_id, 'strictness_level', {STRICT_SQL} FROM d
  UNION ALL SELECT doc_id, 'schema', '{{"required":["' || lang || '"]}}' FROM d
  UNION ALL SELECT doc_id, 'negative_examples', 'Wrong: short' || chr(10) || 'more ' || lang || chr(10) || 'Reason: too short' || chr(10) || '- Wrong: x' FROM d
)"""


def prompts(spark, folder):
    """Two of three documents become structured prompts, the others stay plain text."""
    key = F.col("doc_id")
    structured = F.concat(
        F.lit("ROLE:\nignored\n role :\nYou write "), "lang", F.lit("\nTASK:\n"), "text",
        F.lit("\nGlobal Constraints:\n- Return JSON\n- use "), "lang",
        F.lit("\nCHECKPOINT RULES:\n- tone: calm\n- source: "), "source", F.lit("\n- tone: warm\nSTRICTNESS LEVEL:\n"),
        (key % 8).cast("string"), F.lit('\nJSON SCHEMA:\n{"required":["'), "lang",
        F.lit('"]}\nNEGATIVE EXAMPLES:\nWrong: short\nmore '), "lang", F.lit("\nReason: too short\n- Wrong: x\n"),
    )
    return table(spark, folder, "documents").select(
        "doc_id", "lang", "source", F.when(key % 3 != 0, structured).otherwise(F.col("text")).alias("prompt")
    )


@query("parse_sections", f"WITH {SECTION_ROWS_SQL} SELECT * FROM sect")
def parse_sections(spark, folder):
    return X.parse_sections(prompts(spark, folder), ["doc_id"], "prompt")


EXTRA = ("Return JSON", "Cite sources")
LEVEL_SQL = "CASE WHEN doc_id % 3 = 0 THEN 3 ELSE greatest(1, least(5, doc_id % 8)) END"


def states(spark, folder):
    extra = F.array(*map(F.lit, EXTRA))
    return P.with_prompt_state(prompts(spark, folder), "prompt", extra).select("doc_id", "state")


@query(
    "build_prompt_state",
    f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE '' END AS base_prompt,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'You write ' || lang END AS role,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE trim(text, E' \\t\\n\\r') END AS task,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'tone=warm;source=' || source END AS rules,
  {LEVEL_SQL} AS strictness_level,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'short' || chr(10) || 'more ' || lang || '/too short;x/' END AS examples,
  CASE WHEN doc_id % 3 = 0 THEN 'Return JSON;Cite sources' ELSE 'Return JSON;use ' || lang || ';Cite sources' END AS constraints,
  doc_id % 3 <> 0 AS structured, CASE WHEN doc_id % 3 <> 0 THEN '{{"required":["' || lang || '"]}}' END AS contract
FROM documents""",
)
def build_prompt_state(spark, folder):
    s = F.col("state")
    return states(spark, folder).select(
        "doc_id", "state.base_prompt", "state.role", "state.task",
        F.array_join(F.transform(s["checkpoint_rules"], lambda r: F.concat(r["key"], F.lit("="), r["value"])), ";").alias("rules"),
        s["strictness_level"].alias("strictness_level"),
        F.array_join(
            F.transform(s["negative_examples"], lambda e: F.concat(e["bad_output"], F.lit("/"), F.coalesce(e["reason"], F.lit("")))), ";"
        ).alias("examples"),
        F.array_join(s["global_constraints"], ";").alias("constraints"),
        s["structured"].alias("structured"),
        s["contract"].alias("contract"),
    )


@query(
    "render_prompt_state",
    f"""WITH p AS (SELECT chr(10) || chr(10) AS s, chr(10) AS n)
SELECT doc_id, CASE WHEN doc_id % 3 = 0
  THEN CASE WHEN text = '' THEN '' ELSE text || s END || 'GLOBAL CONSTRAINTS:' || s || '- Return JSON' || s || '- Cite sources' || s || 'STRICTNESS LEVEL:' || n || '3'
  ELSE 'ROLE:' || n || 'You write ' || lang || s || 'TASK:' || n || trim(text, E' \\t\\n\\r') || s || 'GLOBAL CONSTRAINTS:' || s || '- Return JSON' || s || '- use ' || lang
    || s || '- Cite sources' || s || 'CHECKPOINT RULES:' || s || '- tone: warm' || s || '- source: ' || source || s || 'STRICTNESS LEVEL:' || n || {LEVEL_SQL}
    || s || 'NEGATIVE EXAMPLES:' || s || '- Wrong: short' || n || 'more ' || lang || s || '  Reason: too short' || s || '- Wrong: x' END AS text
FROM documents, p""",
)
def render_prompt_state(spark, folder):
    return states(spark, folder).select("doc_id", P.render_state(F.col("state")).alias("text"))


def contract_texts(spark, folder):
    """Schema at the end, indented before another section, as plain format text, or absent."""
    key = F.col("doc_id")
    tail = (
        F.when(key % 4 == 0, F.concat(F.lit('\nOUTPUT JSON SCHEMA:\n{"a": "'), "lang", F.lit('"}')))
        .when(key % 4 == 1, F.concat(F.lit('\nJSON SCHEMA:\n  {"b": 1}\n  '), "source", F.lit("\nNEXT:\nrest")))
        .when(key % 4 == 2, F.concat(F.lit("\nOUTPUT FORMAT:\nplain "), "lang"))
        .otherwise(F.lit("\nno schema"))
    )
    head = F.regexp_replace("text", ":\n", ".\n")  # a line that ends in a colon would start a section
    return table(spark, folder, "documents").select("doc_id", F.concat(head, tail).alias("text"))


CONTRACT_SQL = """WITH c AS (
  SELECT doc_id, replace(text, ':' || chr(10), '.' || chr(10)) AS head, chr(10) AS n, lang, source FROM documents
), e AS (
  SELECT doc_id, head, n,
    CASE doc_id % 4 WHEN 0 THEN 'OUTPUT JSON SCHEMA' WHEN 1 THEN 'JSON SCHEMA' WHEN 2 THEN 'OUTPUT FORMAT' END AS header,
    CASE doc_id % 4 WHEN 0 THEN '{"a": "' || lang || '"}' WHEN 1 THEN '{"b": 1}' || n || '  ' || source WHEN 2 THEN 'plain ' || lang END AS schema
  FROM c
)"""


@query(
    "extract_contract",
    CONTRACT_SQL + """SELECT doc_id, head || n || CASE WHEN header IS NULL THEN 'no schema' ELSE header || ':' || n || '{{RESPONSE_CONTRACT}}' END
  || CASE WHEN doc_id % 4 = 1 THEN 'NEXT:' || n || 'rest' ELSE '' END AS text,
  CASE WHEN header IS NULL THEN NULL WHEN header = 'OUTPUT FORMAT' THEN 'text' ELSE 'json' END AS format_type, schema FROM e""",
)
def extract_contract(spark, folder):
    taken = contract_texts(spark, folder).select("doc_id", P.extract_contract(F.col("text")).alias("c"))
    return taken.select("doc_id", "c.text", "c.format_type", "c.schema")


@query(
    "restore_contract",
    CONTRACT_SQL + """SELECT doc_id, head || n || CASE WHEN header IS NULL THEN 'no schema' ELSE header || ':' || n || schema END
  || CASE WHEN doc_id % 4 = 1 THEN 'NEXT:' || n || 'rest' ELSE '' END AS text,
  CASE WHEN header IS NULL THEN 'tail' ELSE 'tail' || n || n || CASE WHEN header = 'OUTPUT FORMAT' THEN header ELSE 'OUTPUT JSON SCHEMA' END || ':' || n || schema END AS appended FROM e""",
)
def restore_contract(spark, folder):
    taken = contract_texts(spark, folder).select("doc_id", P.extract_contract(F.col("text")).alias("c"))
    c = F.col("c")
    return taken.select(
        "doc_id",
        P.restore_contract(c["text"], c["schema"], c["format_type"]).alias("text"),
        P.restore_contract(F.lit("tail"), c["schema"], c["format_type"]).alias("appended"),
    )


@query(
    "validate_contract",
    """SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'ResponseContract missing required fields: [''' || source || ''']'
  WHEN 2 THEN 'ResponseContract requires valid JSON object output' WHEN 3 THEN 'ResponseContract requires valid JSON object output' END AS problem
FROM documents""",
)
def validate_contract(spark, folder):
    key = F.col("doc_id")
    schema = F.concat(F.lit('{"required":["'), "lang", F.lit('","'), "source", F.lit('"]}'))
    full = F.concat(F.lit('{"'), "lang", F.lit('":1,"'), "source", F.lit('":2}'))
    output = (
        F.when(key % 5 == 0, full)
        .when(key % 5 == 1, F.concat(F.lit('{"'), "lang", F.lit('":1}')))
        .when(key % 5 == 2, F.translate("text", "{}", ""))
        .when(key % 5 == 3, F.lit("[1, 2]"))
        .otherwise(F.concat(F.lit("Here: "), full, F.lit(" done")))
    )
    return table(spark, folder, "documents").select("doc_id", P.validate_contract(schema, output).alias("problem"))


@query(
    "schema_strength",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 5 + 2 * 3 + 2 + 1 + p_size % 3 WHEN 1 THEN 1 WHEN 2 THEN 7 ELSE 0 END AS strength FROM part""",
)
def schema_strength(spark, folder):
    key = F.col("p_partkey")
    enums = F.concat_ws(",", F.transform(F.sequence(F.lit(0), (F.col("p_size") % 3).cast("int")), lambda i: i.cast("string")))
    text = (
        F.when(
            key % 4 == 0,
            F.concat(
                F.lit('Use {"additionalProperties":false,"required":["a","b"],"properties":{"a":{"enum":['), enums,
                F.lit(']},"b":{"type":"x"}}} please'),
            ),
        )
        .when(key % 4 == 1, F.lit('{"additionalProperties":"no","properties":{"a":3}}'))
        .when(key % 4 == 2, F.lit('broken { "required" "enum" additionalProperties'))
        .otherwise(F.lit(""))
    )
    return table(spark, folder, "part").select("p_partkey", P.schema_strength(text).alias("strength"))


BLOCKS_SQL = r"""raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS part, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) - 1 AS no FROM documents
),
kept AS (SELECT * FROM raw WHERE trim(part, E' \t\n\r') <> ''),
blocks AS (
  SELECT doc_id, 'b' || no AS block_id, no, part || chr(10) || chr(10) AS text,
    CASE WHEN contains(part, '输出') OR contains(lower(part), 'output') THEN 'output'
         WHEN contains(part, '示例') OR contains(lower(part), 'example') THEN 'example'
         WHEN contains(part, '必须') OR contains(part, '约束') THEN 'constraint' ELSE 'instruction' END AS kind FROM kept
  UNION ALL SELECT doc_id, 'b0', 0, text, 'other' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM kept)
)"""


def blocks(spark, folder):
    return X.split_text_blocks(table(spark, folder, "documents"), ["doc_id"], "text")


@query("split_text_blocks", f"WITH {BLOCKS_SQL} SELECT doc_id, block_id, kind, text FROM blocks")
def split_text_blocks(spark, folder):
    return blocks(spark, folder).select("doc_id", "block_id", "kind", "text")


@query("merge_text_blocks", f"WITH {BLOCKS_SQL} SELECT doc_id, string_agg(text, '' ORDER BY no) AS text FROM blocks GROUP BY doc_id")
def merge_text_blocks(spark, folder):
    return X.merge_text_blocks(blocks(spark, folder), ["doc_id"])


@query(
    "replace_text_block",
    f"""WITH {BLOCKS_SQL} SELECT doc_id, block_id,
  CASE WHEN block_id = 'b1' AND right(text, 2) = chr(10) || chr(10) THEN 'new ' || lang || chr(10) || chr(10) ELSE text END AS text
FROM (SELECT blocks.*, documents.lang FROM blocks JOIN documents USING (doc_id))""",
)
def replace_text_block(spark, folder):
    new = table(spark, folder, "documents").select(
        "doc_id", F.lit("b1").alias("block_id"), F.concat(F.lit("new "), "lang", F.lit(" \n")).alias("content")
    )
    return X.replace_text_block(blocks(spark, folder), new, ["doc_id"]).select("doc_id", "block_id", "text")


def messages(spark, folder):
    return table(spark, folder, "conversations").select(F.col("conv_id").alias("node_id"), F.col("turn").alias("index"), "role", "text")


MARKED_SQL = """'<ROLE::' || role || '::' || turn || '>' || chr(10) || text || chr(10) || '</ROLE::' || role || '::' || turn || '>'"""


@query(
    "merge_messages",
    f"""SELECT conv_id AS node_id, turn // 1000 AS part, string_agg({MARKED_SQL}, chr(10) ORDER BY turn, role) AS merged_text
FROM conversations GROUP BY 1, 2""",
)
def merge_messages(spark, folder):
    return X.merge_messages(messages(spark, folder), ["node_id"], part_messages=1000).select("node_id", "part", "merged_text")


@query(
    "split_messages",
    r"""SELECT conv_id AS node_id, turn AS "index", role, trim(text, E' \t\n\r') AS text FROM conversations WHERE conv_id % 5 <> 0""",
)
def split_messages(spark, folder):
    merged = X.merge_messages(messages(spark, folder), ["node_id"], part_messages=1000)
    # a rewrite that loses an end marker in every fifth node
    damaged = F.when(F.col("node_id") % 5 == 0, F.replace("merged_text", F.lit("</ROLE::"), F.lit("</R::"))).otherwise(F.col("merged_text"))
    rewritten = merged.withColumn("rewritten", damaged)
    return X.split_messages(rewritten, ["node_id"], "rewritten").select("node_id", "index", "role", "text")


@query(
    "llm_response_text",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 't' || event_id WHEN 'view' THEN 'c' || event_id
  WHEN 'purchase' THEN 'm' || event_id WHEN 'signup' THEN 'x' || event_id ELSE '' END AS response_text FROM events""",
)
def llm_response_text(spark, folder):
    number = F.col("event_id").cast("string")
    raw = (
        F.when(F.col("event_type") == "click", F.concat(F.lit('{"text":"t'), number, F.lit('","content":"no"}')))
        .when(F.col("event_type") == "view", F.concat(F.lit('{"text":"","content":"c'), number, F.lit('"}')))
        .when(F.col("event_type") == "purchase", F.concat(F.lit('{"choices":[{"message":{"content":"m'), number, F.lit('"},"text":"no"}]}')))
        .when(F.col("event_type") == "signup", F.concat(F.lit('{"choices":[{"message":{},"text":"x'), number, F.lit('"}]}')))
        .otherwise(F.lit('{"choices":[]}'))
    )
    parsed = table(spark, folder, "events").select("event_id", F.try_parse_json(raw).alias("v"))
    return parsed.select("event_id", PL.response_text(F.col("v")).alias("response_text"))


JUDGED_SQL = """
judged AS (
  SELECT doc_id, 'wf_' || source AS workflow_id, doc_id % 6 IN (0, 3) AS passed,
    CASE WHEN doc_id % 6 IN (0, 3) THEN 'pass' ELSE 'fail' END AS verdict,
    CASE doc_id % 6 WHEN 1 THEN '[''date'']' ELSE '[]' END AS missing,
    CASE doc_id % 6 WHEN 2 THEN '[''x'', ''' || lang || ''']' ELSE '[]' END AS incorrect,
    CASE doc_id % 6 WHEN 2 THEN false WHEN 4 THEN false WHEN 5 THEN false ELSE true END AS format_ok,
    CASE doc_id % 6 WHEN 1 THEN 'medium' WHEN 2 THEN 'low' WHEN 4 THEN 'high' WHEN 5 THEN 'medium' END AS severity,
    CASE doc_id % 6 WHEN 1 THEN 'Sure: {"verdict":"pass","missing_items":["date"],"format_ok":true} done'
      WHEN 2 THEN 'bad ' || lang WHEN 4 THEN 'cannot say ' || lang
      WHEN 5 THEN '{"verdict":"pass","format_ok":false,"severity":"huge"}' END AS reason
  FROM documents
)"""


def judge_answers(spark, folder):
    """Raw judge answers: clean, wrapped in prose, failing, spoken, unreadable and badly formed."""
    shapes = F.array(
        F.lit('{"verdict":"pass","missing_items":[],"incorrect_items":[],"format_ok":true}'),
        F.lit('Sure: {"verdict":"pass","missing_items":["date"],"format_ok":true} done'),
        F.concat(F.lit('{"verdict":"FAIL","incorrect_items":["x","'), "lang", F.lit('"],"format_ok":false,"reason":"bad '), "lang", F.lit('","severity":"LOW"}')),
        F.lit("I think it should PASS"),
        F.concat(F.lit("cannot say "), "lang"),
        F.lit('{"verdict":"pass","format_ok":false,"severity":"huge"}'),
    )
    return table(spark, folder, "documents").select(
        "doc_id", F.concat(F.lit("wf_"), "source").alias("workflow_id"), F.col("doc_id").alias("index"),
        F.element_at(shapes, (F.col("doc_id") % 6 + 1).cast("int")).alias("raw"),
    )


@query(
    "parse_judge_verdict",
    f"""WITH {JUDGED_SQL} SELECT doc_id, passed, verdict, missing, incorrect, format_ok, severity,
  'LLM judge flagged mismatch: ' || reason || ' | missing_items=' || missing || ' | incorrect_items=' || incorrect
    || ' | format_ok=' || CASE WHEN format_ok THEN 'True' ELSE 'False' END AS message FROM judged""",
)
def parse_judge_verdict(spark, folder):
    return X.parse_judge_verdict(judge_answers(spark, folder), "raw").select(
        "doc_id", "passed", "verdict", P.listed(F.col("missing_items")).alias("missing"),
        P.listed(F.col("incorrect_items")).alias("incorrect"), "format_ok", "severity", "message",
    )


@query(
    "parse_action_judge",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'fail' WHEN 1 THEN 'pass' ELSE CASE doc_id % 4 WHEN 2 THEN 'pass' ELSE 'fail' END END AS verdict,
  CASE doc_id % 4 WHEN 0 THEN 'tighten_schema:' || lang || ':c;rewrite::' ELSE '' END AS actions FROM documents""",
)
def parse_action_judge(spark, folder):
    key = F.col("doc_id")
    raw = (
        F.when(key % 4 == 0, F.concat(F.lit('{"verdict":"Fail","actions":[{"type":"tighten_schema","target":"'), "lang", F.lit('","content":"c"},7,{"action":"rewrite"}]}')))
        .when(key % 4 == 1, F.lit('{"verdict":"","actions":"none, it may pass"}'))
        .when(key % 4 == 2, F.lit("PASS with pride"))
        .otherwise(F.lit("no idea"))
    )
    done = X.parse_action_judge(table(spark, folder, "documents").select("doc_id", raw.alias("raw")), "raw")
    spoken = F.transform(
        "actions", lambda a: F.concat(a["type"], F.lit(":"), F.coalesce(a["target"], F.lit("")), F.lit(":"), F.coalesce(a["content"], F.lit("")))
    )
    return done.select("doc_id", "verdict", F.array_join(spoken, ";").alias("actions"))
