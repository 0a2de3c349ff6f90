"""Format alignment and validity over chats, pairs and preferences."""

from pyspark.sql import functions as F

from prefmill.operators import align as A
from prefmill.plans import fixtures as X
from prefmill.plans.base import h, query
from prefmill.session import settled
from prefmill.sources.registry import DatasetSpec


def flat(messages):
    return F.array_join(F.transform(messages, lambda m: F.concat_ws("=", m["role"], m["content"])), "|")


def hub_text(df, *keep):
    return df.select(*keep, flat("_prompt").alias("prompt"), flat("_response").alias("response"),
                     F.col("_system").alias("system"), F.col("_tools").alias("tools"))


def flat_rich(messages):
    return F.array_join(F.transform(messages, lambda m: F.concat(
        m["role"], F.lit("="), F.array_join(F.transform(m["content"], lambda p: F.concat_ws(":", p["type"], p["value"])), "+"),
        F.lit("@"), m["loss_weight"].cast("int").cast("string"))), "|")


@query("group_turns", """
SELECT conv_id, count(*)::BIGINT AS n, string_agg(role||'='||text,'|' ORDER BY turn) AS messages
FROM conversations GROUP BY conv_id""")
def group_turns(spark, folder):
    out = A.group_turns(X.table(spark, folder, "conversations"))
    return out.select("conv_id", F.size("messages").cast("bigint").alias("n"), flat("messages").alias("messages"))


@query("align_alpaca", f"""WITH {X.PAIRS}
SELECT id, concat_ws('|', string_agg('user='||instruction||'|assistant='||output,'|') OVER (
         PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
       'user='||instruction||CASE WHEN input<>'' THEN chr(10)||input ELSE '' END) AS prompt,
       'assistant='||output AS response, system, '' AS tools FROM pairs""")
def align_alpaca(spark, folder):
    spec = DatasetSpec("pairs", system="system", history="history")
    return hub_text(A.align(X.alpaca(spark, folder), spec, keep=["id"]), "id")


HUB_SQL = f"""WITH {X.BODY}
SELECT v.conv_id, coalesce(string_agg(CASE WHEN g.i<g.n-1 THEN g.role||'='||g.text END,'|' ORDER BY g.i),'') AS prompt,
       coalesce(string_agg(CASE WHEN g.i=g.n-1 THEN g.role||'='||g.text END,'|' ORDER BY g.i),'') AS response,
       max(s.system) AS system, '' AS tools
FROM sys s JOIN valid v USING (conv_id) LEFT JOIN good g USING (conv_id) GROUP BY v.conv_id"""


@query("align_sharegpt", HUB_SQL)
def align_sharegpt(spark, folder):
    return hub_text(X.hub(spark, folder), "conv_id")


def openai_chats(spark, folder):
    """Chats whose answers, in a fifth of the conversations, come after a tool call with two results."""
    grouped = A.group_turns(X.table(spark, folder, "conversations"))
    call_type = "array<struct<function:struct<name:string,arguments:string>>>"
    none = F.array().cast(call_type)
    with_tools = X.tag("tool", "conv_id") % 5 == 0

    def msg(role, content, calls=None):
        return F.struct(F.lit(role).alias("role") if isinstance(role, str) else role.alias("role"), content.alias("content"),
                        (none if calls is None else calls).alias("tool_calls"))

    def widen(m, i):
        call = F.array(F.struct(F.struct(F.lit("lookup").alias("name"), F.concat(
            F.lit('{"k": '), i.cast("string"), F.lit("}")).alias("arguments")).alias("function"))).cast(call_type)
        plain = msg(m["role"], m["content"])
        return F.when(with_tools & (m["role"] == "assistant"), F.array(
            msg("assistant", F.lit(""), call), msg("tool", F.concat(F.lit("first "), i.cast("string"))),
            msg("tool", F.lit("second")), plain)).otherwise(F.array(plain))

    return grouped.select("conv_id", F.flatten(F.transform("messages", widen)).alias("messages"),
                          F.when(with_tools, X.TOOLS_JSON).otherwise("").alias("tools"))


OPENAI = DatasetSpec("openai", formatting="openai", messages="messages", tools="tools", role_tag="role",
                     content_tag="content", user_tag="user", assistant_tag="assistant", observation_tag="tool",
                     function_tag="function", system_tag="system")


@query("align_openai", f"""WITH {X.BODY}, wide AS (
  SELECT b.*, (SELECT count(*) FROM conversations c WHERE c.conv_id=b.conv_id AND c.role='system' AND c.turn=0) AS shift,
         {h("'tool:'||conv_id")} % 5 = 0 AS tooled FROM body b),
lines AS (
  SELECT conv_id, i*10 AS o, role, text, i=n-1 AS last FROM wide WHERE NOT (tooled AND role='assistant')
  UNION ALL SELECT conv_id, i*10, 'function', '[{{"name": "lookup", "arguments": "{{\\"k\\": '||(i+shift)||'}}"}}]', false
    FROM wide WHERE tooled AND role='assistant'
  UNION ALL SELECT conv_id, i*10+1, 'observation', 'first '||(i+shift)||chr(10)||'</tool_response>'||chr(10)||'<tool_response>'||chr(10)||'second', false
    FROM wide WHERE tooled AND role='assistant'
  UNION ALL SELECT conv_id, i*10+2, role, text, i=n-1 FROM wide WHERE tooled AND role='assistant'),
out AS (
  SELECT l.conv_id, string_agg(CASE WHEN NOT last THEN l.role||'='||l.text END,'|' ORDER BY o) AS prompt,
         max(CASE WHEN last THEN l.role||'='||l.text END) AS response FROM lines l GROUP BY l.conv_id)
SELECT s.conv_id, CASE WHEN v.ordered AND v.n%2=0 THEN prompt ELSE '' END AS prompt,
       CASE WHEN v.ordered AND v.n%2=0 THEN response ELSE '' END AS response,
       CASE WHEN {h("'tool:'||s.conv_id")} % 5 = 0 THEN CASE WHEN system='' THEN '' ELSE system||chr(10) END
            WHEN system='' THEN 'detailed thinking off'
            WHEN contains(system,'detailed thinking on') OR contains(system,'detailed thinking off') THEN system
            ELSE system||chr(10)||'detailed thinking off' END AS system,
       CASE WHEN {h("'tool:'||s.conv_id")} % 5 = 0 THEN '{X.TOOLS_JSON}' ELSE '' END AS tools
FROM sys s JOIN valid v USING (conv_id) JOIN out o ON o.conv_id=s.conv_id""")
def align_openai(spark, folder):
    return hub_text(A.align(openai_chats(spark, folder), OPENAI, keep=["conv_id"]), "conv_id")


@query("align_v1_alpaca", f"""WITH {X.PAIRS}
SELECT id, coalesce('system=text:'||system||'@0|','')||'user=text:'||instruction||input||'@0|assistant=text:'||output||'@1'
       AS messages FROM pairs""")
def align_v1_alpaca(spark, folder):
    out = A.align_v1_alpaca(X.pairs(spark, folder), keep=["id"])
    return out.select("id", flat_rich("messages").alias("messages"))


def tool_chats(spark, folder):
    """Chats where some answers follow a function call (now and then with broken JSON) and its result."""
    with_tools = X.tag("tool", "conv_id") % 5 == 0

    def widen(m, i):
        bad = X.tag("bad", "conv_id", i) % 7 == 0
        call = F.when(bad, F.lit('{"name": ')).otherwise(F.concat(
            F.lit('{"name":"lookup","arguments":{"k":'), i.cast("string"), F.lit("}}")))
        def pair(tag, value):
            return F.struct(F.lit(tag).alias("from"), value.alias("value"))
        return F.when(with_tools & (m["from"] == "gpt"), F.array(
            pair("function_call", call), pair("observation", F.lit("found")), m)).otherwise(F.array(m))

    return X.chats(spark, folder).select("conv_id", F.flatten(F.transform("conversations", widen)).alias("conversations"),
                                         F.lit(X.TOOLS_JSON).alias("tools"))


@query("align_v1_sharegpt", f"""
SELECT conv_id, string_agg(CASE role WHEN 'system' THEN 'system=text:'||text||'@0' WHEN 'user' THEN 'user=text:'||text||'@0'
  ELSE CASE WHEN {h("'tool:'||conv_id")} % 5 <> 0 THEN '' ELSE
         CASE WHEN {h("'bad:'||conv_id||':'||turn")} % 7 = 0 THEN ''
              ELSE 'assistant=tool_call:{{"name": "lookup", "arguments": {{"k": '||turn||'}}}}@1|' END
         ||'tool=text:found@0|' END ||'assistant=text:'||text||'@1' END,'|' ORDER BY turn) AS messages,
  '{X.TOOLS_JSON}' AS tools
FROM conversations GROUP BY conv_id""")
def align_v1_sharegpt(spark, folder):
    out = A.align_v1_sharegpt(tool_chats(spark, folder), keep=["conv_id"])
    return out.select("conv_id", flat_rich("messages").alias("messages"), "tools")


def message_pairs(spark, folder):
    """Preferences as two message lists; a fourth of them carry a tool message, some of it not JSON."""
    def side(name):
        call = F.when(X.tag("bad", "id") % 3 == 0, "not json").otherwise('{"name":"f","arguments":{}}')
        base = [("user", F.col("prompt")), ("assistant", F.col(name))]
        plain = F.array(*[A.message(r, c) for r, c in base])
        return F.when(X.tag("call", "id") % 4 == 0, F.concat(plain, F.array(A.message("tool", call)))).otherwise(plain)
    return X.preferences(spark, folder).select("id", side("chosen").alias("chosen"), side("rejected").alias("rejected"))


PAIR_TAIL = f"""CASE WHEN {h("'call:'||id")} % 4 = 0 AND {h("'bad:'||id")} % 3 <> 0
  THEN '|tool=tool_call:{{"name": "f", "arguments": {{}}}}@0' ELSE '' END"""


@query("align_v1_pair", f"""WITH {X.PREFS}
SELECT id, 'user=text:'||prompt||'@0|assistant=text:'||chosen||'@1'||{PAIR_TAIL} AS chosen_messages,
       'user=text:'||prompt||'@0|assistant=text:'||rejected||'@1'||{PAIR_TAIL} AS rejected_messages FROM prefs""")
def align_v1_pair(spark, folder):
    out = A.align_v1_pair(message_pairs(spark, folder), keep=["id"])
    return out.select("id", *[flat_rich(f"{s}_messages").alias(f"{s}_messages") for s in ("chosen", "rejected")])


@query("validate_roles", f"""WITH {X.BODY}
SELECT CASE WHEN NOT ordered THEN 'order' WHEN n%2<>0 THEN 'parity' ELSE 'ok' END AS reason, count(*)::BIGINT AS n
FROM valid GROUP BY 1""")
def validate_roles(spark, folder):
    body = F.filter("messages", lambda m, i: ~((i == 0) & (m["role"] == "system")))
    grouped = A.group_turns(X.table(spark, folder, "conversations"))
    return grouped.groupBy(A.role_fault(body).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("drop_invalid", f"""WITH {X.BODY}, k AS (
  SELECT conv_id, ordered AND n%2=0 AS ok FROM valid)
SELECT conv_id AS id, 'sft' AS stage, ok AS kept FROM k UNION ALL SELECT conv_id, 'ppo', ok FROM k UNION ALL SELECT conv_id, 'rm', false FROM k""")
def drop_invalid(spark, folder):
    """Kept and rejected rows of each stage, through the operator. Conversations are grouped and aligned once; of their
    messages only the roles are written, which all six results read."""
    hub = X.hub(spark, folder)
    roles = [F.transform(c, lambda m: m["role"]).alias(c) for c in ("_prompt", "_response")]
    aligned = settled(hub.select("conv_id", *roles))
    out = []
    for stage in ("sft", "ppo", "rm"):
        for kept, rows in zip((True, False), A.drop_invalid(aligned, stage)):
            out.append(rows.select(F.col("conv_id").alias("id"), F.lit(stage).alias("stage"), F.lit(kept).alias("kept")))
    first, *more = out
    for rows in more:
        first = first.unionByName(rows)
    return first
