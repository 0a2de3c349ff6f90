"""Chat rendering, tool text, tool calls and prompts."""

from pyspark.sql import functions as F

from prefmill.functions.hashing import hash32
from prefmill.functions.text import digest
from prefmill.operators import align as A, mcq as M, render as R, tools as T
from prefmill.operators.judge import RUBRIC, judge_prompt as fill_rubric
from prefmill.operators.templates import TEMPLATES, pieces, stop_words as stops, template, template_table
from prefmill.operators.tokens import char_ids
from prefmill.plans import fixtures as X
from prefmill.plans.align_queries import tool_chats
from prefmill.plans.base import chars, commas, h, query

NAMES = sorted(TEMPLATES)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def template_values(names):
    cells = ("name", "prefix", "user_head", "user_tail", "assistant_head", "assistant_tail", "system_head",
             "system_tail", "default_system", "kind", "eos")
    rows = []
    for i, n in enumerate(names):
        p = pieces(TEMPLATES[n])
        rows.append(f"({i}, {', '.join(lit(p[c]) for c in cells)}, {lit('|'.join(sorted({p['eos'], *p['stop_words']})))})")
    return f"t(idx, name, prefix, uh, ut, ah, az, sh, st, dsys, kind, eos, stops) AS (VALUES {', '.join(rows)})"


def rendered(names):
    """Body turns rendered with a template picked by hash."""
    return f"""{X.BODY}, {template_values(names)}, blocks AS (
  SELECT body.*, t.*, CASE WHEN system<>'' OR dsys<>'' THEN sh||CASE WHEN system<>'' THEN system ELSE dsys END||st ELSE '' END AS blk
  FROM body JOIN sys USING (conv_id) JOIN t ON t.idx = {h("'tpl:'||conv_id")} % {len(names)}),
lines AS (
  SELECT conv_id, i, name, CASE WHEN i=0 THEN prefix || CASE WHEN kind<>'system_in_user' THEN blk ELSE '' END ELSE '' END
    || CASE WHEN role='user' THEN uh || CASE WHEN kind='system_in_user' AND i=0 THEN blk ELSE '' END || text || ut
            ELSE ah || text || az END AS line FROM blocks)"""


def split_rows(spark, folder):
    """conv_id, system, messages without the leading system turn."""
    grouped = A.group_turns(X.table(spark, folder, "conversations"))
    leads = F.get("messages", F.lit(0))["role"] == "system"
    return grouped.select("conv_id", F.when(leads, F.get("messages", F.lit(0))["content"]).otherwise("").alias("system"),
                          F.filter("messages", lambda m, i: ~((i == 0) & (m["role"] == "system"))).alias("messages"))


def named(df, names):
    choices = F.array(*[F.lit(n) for n in names])
    return df.withColumn("template", F.get(choices, (X.tag("tpl", "conv_id") % len(names)).cast("int")))


@query("render_chat", f"""WITH {rendered(NAMES)}
SELECT conv_id, name AS template, count(*)::BIGINT AS n, string_agg(line,'' ORDER BY i) AS text FROM lines GROUP BY ALL""")
def render_chat(spark, folder):
    out = R.render_chat(named(split_rows(spark, folder), NAMES), template_table(spark), formats=())
    return out.select("conv_id", "template", F.size("turns").cast("bigint").alias("n"), "text")


@query("render_system_in_user", f"""WITH {rendered(['llama2'])}
SELECT conv_id, string_agg(line,'' ORDER BY i) AS text FROM lines GROUP BY ALL""")
def render_system_in_user(spark, folder):
    turns = R.render_turns(F.col("messages"), F.col("system"), template("llama2"), name="llama2")
    return split_rows(spark, folder).select("conv_id", F.array_join(turns, "").alias("text"))


def thought_rows(spark, folder):
    """Valid chats in which half of the answers start with a thought; messages are question and answer turns."""
    hub = X.hub(spark, folder).filter(A.usable("sft"))
    messages = F.concat("_prompt", "_response")
    told = F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), F.when(
        (i % 2 == 1) & (X.tag("th", "conv_id", i) % 2 == 0),
        F.concat(F.lit("<think>\nidea "), i.cast("string"), F.lit("\n</think>\n\n"), m["content"])).otherwise(m["content"]).alias("content")))
    return hub.select("conv_id", F.col("_system").alias("system"), told.alias("messages"))


_Q = pieces(TEMPLATES["qwen3"])


@query("render_reasoning", f"""WITH {X.BODY}, m AS (
  SELECT *, i%2=1 AND {h("'th:'||conv_id||':'||i")} % 2 = 0 AS thinks FROM good), w AS (
  SELECT m.*, mode FROM m, (VALUES ('on'),('off'),('none')) x(mode)), pr AS (
  SELECT a.conv_id, a.mode, a.i//2 AS pair,
    CASE WHEN a.i=0 AND a.system<>'' THEN {lit(_Q['system_head'])}||a.system||{lit(_Q['system_tail'])} ELSE '' END
      || {lit(_Q['user_head'])}||a.text||{lit(_Q['user_tail'])}
      || CASE WHEN (NOT b.thinks OR a.mode='off') AND a.mode<>'on' THEN {lit(R.empty_thought('qwen3'))} ELSE '' END AS prompt,
    CASE WHEN NOT b.thinks AND a.mode='on' THEN {lit(R.empty_thought('qwen3'))} ELSE '' END
      || CASE WHEN b.thinks AND a.mode<>'off' THEN '<think>'||chr(10)||'idea '||b.i||chr(10)||'</think>'||chr(10)||chr(10) ELSE '' END
      || b.text || {lit(_Q['assistant_tail'])} AS response
  FROM w a JOIN w b ON a.conv_id=b.conv_id AND a.mode=b.mode AND b.i=a.i+1 WHERE a.i%2=0)
SELECT conv_id, mode, pair::BIGINT AS pair, prompt, response FROM pr""")
def render_reasoning(spark, folder):
    rows = thought_rows(spark, folder)
    tpl = template("qwen3")
    modes = [F.struct(F.lit(label).alias("mode"), R.render_pairs(F.col("messages"), F.col("system"), "qwen3", tpl, mode).alias("pairs"))
             for label, mode in (("on", True), ("off", False), ("none", None))]
    spread = rows.select("conv_id", F.explode(F.array(*modes)).alias("m"))
    return spread.select("conv_id", "m.mode", F.posexplode("m.pairs").alias("pair", "p")).select(
        "conv_id", "mode", F.col("pair").cast("bigint").alias("pair"), "p.prompt", "p.response")


def segments_text(segments):
    return F.array_join(F.transform(segments, lambda s: F.concat(s["text"], F.lit("@"), s["weight"].cast("int").cast("string"))), "|")


@query("render_chatml_v1", f"""WITH {X.PAIRS}
SELECT id, coalesce('<|im_start|>system'||chr(10)||system||'<|im_end|>'||chr(10)||'@0|','')
  ||'<|im_start|>user'||chr(10)||instruction||input||'<|im_end|>'||chr(10)||'@0|<|im_start|>assistant'||chr(10)||output||'<|im_end|>'||chr(10)||'@1|'
  ||'<|im_start|>assistant'||chr(10)||'@0' AS segments FROM pairs""")
def render_chatml_v1(spark, folder):
    rows = A.align_v1_alpaca(X.pairs(spark, folder), keep=["id"])
    return rows.select("id", segments_text(R.render_chatml_v1(F.col("messages"), generate=True)).alias("segments"))


_TB, _TA = T.TOOL_PROMPTS["qwen"]


@query("render_v1_tools", f"""WITH s AS (
  SELECT conv_id, max(CASE WHEN turn=0 AND role='system' THEN text END) AS system FROM conversations GROUP BY 1)
SELECT c.conv_id, '<|im_start|>system'||chr(10)||coalesce(max(s.system)||chr(10)||chr(10),'')||{lit(_TB.lstrip(chr(10)))}||chr(10)||{lit(X.TOOLS_JSON)}[2:-2]||{lit(_TA)}||'<|im_end|>'||chr(10)||'@0|'
  || string_agg(CASE role WHEN 'user' THEN '<|im_start|>user'||chr(10)||text||'<|im_end|>'||chr(10)||'@0' ELSE
    CASE WHEN {h("'tool:'||c.conv_id")} % 5 <> 0 THEN '' ELSE
      CASE WHEN {h("'bad:'||c.conv_id||':'||turn")} % 7 = 0 THEN ''
        ELSE '<|im_start|>assistant'||chr(10)||'<tool_call>'||chr(10)||'{{"name": "lookup", "arguments": {{"k": '||turn||'}}}}'||chr(10)||'</tool_call><|im_end|>'||chr(10)||'@1|' END
      ||'<|im_start|>user'||chr(10)||'<tool_response>'||chr(10)||'found'||chr(10)||'</tool_response><|im_end|>'||chr(10)||'@0|' END
    ||'<|im_start|>assistant'||chr(10)||text||'<|im_end|>'||chr(10)||'@1' END, '|' ORDER BY turn) FILTER (NOT (turn=0 AND role='system')) AS segments
FROM conversations c JOIN s USING (conv_id) GROUP BY c.conv_id""")
def render_v1_tools(spark, folder):
    rows = A.align_v1_sharegpt(tool_chats(spark, folder), keep=["conv_id"])
    return rows.select("conv_id", segments_text(R.render_v1_tools(F.col("messages"), F.col("tools"))).alias("segments"))


def _side(name):
    text = f"'<|im_start|>user'||chr(10)||prompt||'<|im_end|>'||chr(10)||'<|im_start|>assistant'||chr(10)||{name}||'<|im_end|>'||chr(10)"
    return chars(text)


@query("render_pair_v1", f"""WITH {X.PREFS}, e AS (SELECT id, {_side('chosen')} AS c, {_side('rejected')} AS r FROM prefs)
SELECT id, {commas('c||r')} AS input_ids, len(c)::BIGINT AS ones, len(r)::BIGINT AS twos FROM e""")
def render_pair_v1(spark, folder):
    rows = X.preferences(spark, folder)
    def ids(side):
        messages = F.array(A.rich("user", F.array(A.part("text", F.col("prompt"))), 0), A.rich("assistant", F.array(A.part("text", F.col(side))), 1))
        return R.segments_to_ids(R.render_chatml_v1(messages), char_ids)[0]
    both = rows.select("id", ids("chosen").alias("c"), ids("rejected").alias("r"))
    joined, marks = R.join_pair(F.col("c"), F.col("r"))
    ones, twos = F.filter(marks, lambda x: x == 1), F.filter(marks, lambda x: x == 2)
    return both.select("id", digest(joined).alias("input_ids"), F.size(ones).cast("bigint").alias("ones"),
                       F.size(twos).cast("bigint").alias("twos"))


def generated(spark, folder):
    """Answers with a thought in two thirds of the rows and a call, sometimes broken, in half of them."""
    n = X.tag("gen", "id")
    thought = F.when(n % 3 != 0, F.concat(F.lit("<thinking>\n"), F.col("instruction"), F.lit("\n</thinking>\n\n"))).otherwise("")
    call = F.when(n % 2 != 0, "").when(n % 10 == 0, "\n<tool_call>\n{broken\n</tool_call>").otherwise(
        '\n<tool_call>\n{"name": "f", "arguments": {}}\n</tool_call>')
    return X.pairs(spark, folder).select("id", F.concat(thought, F.col("output"), call).alias("text"))


_WS = "' '||chr(9)||chr(10)||chr(13)||chr(12)||chr(11)"


@query("parse_generated", f"""WITH {X.PAIRS}, g AS (SELECT *, {h("'gen:'||id")} AS n FROM pairs), parts AS (
  SELECT id, 0 AS o, 'reasoning' AS type, trim(instruction, {_WS}) AS value FROM g WHERE n%3<>0
  UNION ALL SELECT id, 1, 'text', trim(output, {_WS}) FROM g WHERE trim(output, {_WS})<>''
  UNION ALL SELECT id, 2, CASE WHEN n%10=0 THEN 'bad_call' ELSE 'tool_call' END,
     CASE WHEN n%10=0 THEN '{{broken' ELSE '{{"name": "f", "arguments": {{}}}}' END FROM g WHERE n%2=0)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY o) - 1 AS idx, type, value FROM parts""")
def parse_generated(spark, folder):
    rows = generated(spark, folder).select("id", F.posexplode(T.parse_generated(F.col("text"))).alias("idx", "p"))
    return rows.select("id", F.col("idx").cast("bigint").alias("idx"), "p.type", "p.value")


def catalogue(spark, folder):
    """One tool per (source, language) of the documents; some arguments are optional."""
    tools = X.table(spark, folder, "documents").select("source", "lang").distinct()
    required = F.when(X.tag("req", "source") % 2 == 0, '["k"]').otherwise("[]")
    text = F.concat(F.lit('[{"name": "'), F.col("source"), F.lit('", "description": "'), F.col("lang"), F.lit(
        ' texts", "parameters": {"type": "object", "properties": {"k": {"type": "number", "description": "key"}, '
        '"mode": {"type": "string", "enum": ["a", "b"]}, "ids": {"type": "array", "description": "list", '
        '"items": {"type": "number"}}}, "required": '), required, F.lit("}}]"))
    return tools.withColumn("tools", text)


def _tool_sql():
    req = f"""CASE WHEN {h("'req:'||source")} % 2 = 0 THEN '["k"]' ELSE '[]' END"""
    inner = ("""'{"name": "'||source||'", "description": "'||lang||' texts", "parameters": {"type": "object", "properties": {"k": {"type": "number", "description": "key"}, "mode": {"type": "string", "enum": ["a", "b"]}, "ids": {"type": "array", "description": "list", "items": {"type": "number"}}}, "required": '||""" + req + "||'}}'")
    wrapped = f"""'{{"type": "function", "function": '||{inner}||'}}'"""

    def pretty(base):
        pad = " " * base
        lines = ['"parameters": {', '    "type": "object",', '    "properties": {', '        "k": {',
                 '            "type": "number",', '            "description": "key"', '        },', '        "mode": {',
                 '            "type": "string",', '            "enum": [', '                "a",', '                "b"',
                 '            ]', '        },', '        "ids": {', '            "type": "array",',
                 '            "description": "list",', '            "items": {', '                "type": "number"',
                 '            }', '        }', '    },', '    "required": ']
        body = "\n".join(pad + "    " + x for x in lines)
        need = f"""CASE WHEN {h("'req:'||source")} % 2 = 0 THEN {lit('[' + chr(10) + pad + '            "k"' + chr(10) + pad + '        ]')} ELSE '[]' END"""
        return (lit("{\n" + pad + '    "name": "') + "||source||" + lit('",\n' + pad + '    "description": "') + "||lang||"
                + lit(' texts",\n' + body) + "||" + need + "||" + lit("\n" + pad + "    }\n" + pad + "}"))

    described = (lit("> Tool Name: ") + "||source||" + lit("\nTool Description: ") + "||lang||" + lit(" texts\nTool Args:\n  - k (number")
                 + f"""||CASE WHEN {h("'req:'||source")} % 2 = 0 THEN ', required' ELSE '' END||"""
                 + lit("): key\n  - mode (string): , should be one of [a, b]\n  - ids (array): list, where each item should be number\n\n"))
    body = {"default": described, "glm4": lit("\n\n## ") + "||source||" + lit("\n\n") + "||" + pretty(0) + "||" + lit("\n在调用上述函数时，请使用 Json 格式表示调用的参数。"),
            "llama3": lit('{\n    "type": "function",\n    "function": ') + "||" + pretty(4) + "||" + lit("\n}\n\n"),
            "minimax1": inner + "||chr(10)", "minimax2": "'<tool>'||" + inner + "||'</tool>'||chr(10)", "mistral": wrapped,
            "qwen3_5": "chr(10)||" + inner, "seed_oss": "'['||" + inner + "||']'", "lfm2": inner}
    rows = []
    for fmt, (before, after) in T.TOOL_PROMPTS.items():
        text = body.get(fmt, "chr(10)||" + wrapped)
        tail = lit(after).replace("@names@", "'||source||'")
        rows.append(f"SELECT source, lang, '{fmt}' AS fmt, {lit(before.replace('@date@', '01 Jan 2024'))}||{text}||{tail} AS prompt FROM d")
    return "WITH d AS (SELECT DISTINCT source, lang FROM documents) " + " UNION ALL ".join(rows)


@query("tool_prompt", _tool_sql())
def tool_prompt(spark, folder):
    shown = F.array(*[F.struct(F.lit(f).alias("fmt"), T.tool_prompt(F.col("tools"), f, "01 Jan 2024").alias("prompt")) for f in T.FORMATS])
    return catalogue(spark, folder).select("source", "lang", F.explode(shown).alias("s")).select("source", "lang", "s.fmt", "s.prompt")


def call_rows(spark, folder):
    """id, calls: one call object, or (for a third of the pairs) a list of two."""
    first = F.concat(F.lit('{"name":"lookup","arguments":{"k":'), F.col("id").cast("string"), F.lit(',"q":"'),
                     F.lit("w"), F.substring(F.md5("instruction"), 1, 6), F.lit('"}}'))
    second = F.lit('{"name":"scan","arguments":{"deep":{"a":[1,2]},"flag":true}}')
    two = X.tag("two", "id") % 3 == 0
    return X.pairs(spark, folder).select("id", two.alias("two"), F.when(
        two, F.concat(F.lit("["), first, F.lit(","), second, F.lit("]"))).otherwise(first).alias("calls"))


_ONE = ("lookup", """'{"k": '||id||', "q": "'||q||'"}'""", [("k", "id::VARCHAR", False), ("q", "q", True)])
_TWO = ("scan", """'{"deep": {"a": [1, 2]}, "flag": true}'""", [("deep", """'{"a": [1, 2]}'""", False), ("flag", "'true'", False)])


def _call_sql(fmt, call):
    name, args, kvs = call
    def each(a, b, c):
        return "||".join(f"{lit(a + k + b)}||{v}||{lit(c)}" for k, v, _ in kvs)
    obj = f"""'{{"name": "{name}", "arguments": '||{args}||'}}'"""
    return {
        "default": f"'Action: {name}'||chr(10)||'Action Input: '||{args}", "glm4": f"'{name}'||chr(10)||{args}",
        "llama3": f"""'{{"name": "{name}", "parameters": '||{args}||'}}'""", "mistral": obj, "minimax1": obj,
        "qwen": f"'<tool_call>'||chr(10)||{obj}||chr(10)||'</tool_call>'", "ling": f"'<tool_call>'||chr(10)||{obj}||chr(10)||'</tool_call>'",
        "minimax2": f"""'<invoke name="{name}">'||""" + each('\n<parameter name="', '">', "</parameter>") + "||chr(10)||'</invoke>'",
        "qwen3_5": f"'<tool_call>'||chr(10)||'<function={name}>'||" + each("\n<parameter=", ">\n", "\n</parameter>") + "||chr(10)||'</function>'||chr(10)||'</tool_call>'",
        "glm4_moe": f"chr(10)||'<tool_call>{name}'||" + each("\n<arg_key>", "</arg_key>\n<arg_value>", "</arg_value>"),
        "seed_oss": f"chr(10)||'<seed:tool_call>'||chr(10)||'<function={name}>'||" + each("\n<parameter=", ">", "</parameter>") + "||chr(10)||'</function>'||chr(10)||'</seed:tool_call>'",
        "lfm2": f"'{name}('||" + "||', '||".join(f"""'{k}='||{chr(39) + chr(34) + chr(39) + '||' + v + '||' + chr(39) + chr(34) + chr(39) if t else v}""" for k, v, t in kvs) + "||')'",
    }[fmt]


def _calls_sql(fmt):
    one, two = _call_sql(fmt, _ONE), _call_sql(fmt, _TWO)
    joint = "', '" if fmt in ("llama3", "mistral", "lfm2") else "chr(10)"
    single, double = one, f"{one}||{joint}||{two}"
    if fmt == "glm4":
        double = "NULL"
    if fmt == "llama3":
        double = f"'['||{double}||']'"
    wrap = {"mistral": ("'['", "']'"), "minimax1": ("'<tool_calls>'||chr(10)", "chr(10)||'</tool_calls>'"),
            "lfm2": ("'<|tool_call_start|>['", "']<|tool_call_end|>'")}.get(fmt)
    if wrap:
        single, double = f"{wrap[0]}||{single}||{wrap[1]}", f"{wrap[0]}||{double}||{wrap[1]}"
    return f"SELECT id, '{fmt}' AS fmt, CASE WHEN two THEN {double} ELSE {single} END AS text FROM c"


CALL_SQL = f"""{X.PAIRS}, c AS (SELECT id, 'w'||substr(md5(instruction),1,6) AS q, {h("'two:'||id")} % 3 = 0 AS two FROM pairs)"""


def call_texts(spark, folder):
    shown = F.array(*[F.struct(F.lit(f).alias("fmt"), T.render_function(F.col("calls"), f).alias("text")) for f in T.FORMATS])
    return call_rows(spark, folder).select("id", F.explode(shown).alias("s")).select("id", "s.fmt", "s.text")


@query("tool_call_render", f"WITH {CALL_SQL} " + " UNION ALL ".join(_calls_sql(f) for f in T.FORMATS))
def tool_call_render(spark, folder):
    return call_texts(spark, folder)


READABLE = [f for f in T.FORMATS if f != "glm4_moe"]


def damaged(spark, folder):
    """Rendered calls in every syntax that can be read back; an eleventh of them lost their closing braces and tags."""
    bad = X.tag("bad", "id", F.col("fmt")) % 11 == 0
    tagged = F.when(F.col("fmt") == "minimax2", F.concat(F.lit("<minimax:tool_call>\n"), F.col("text"), F.lit("\n</minimax:tool_call>"))).otherwise(F.col("text"))
    cut = F.regexp_replace(tagged, "[}<]", "")
    return call_texts(spark, folder).filter(F.col("fmt").isin(READABLE) & F.col("text").isNotNull()).select(
        "id", "fmt", F.when(bad, cut).otherwise(tagged).alias("text"))


_FMTS = ", ".join(f"('{f}')" for f in READABLE)
_LIVE = f"""live AS (SELECT c.*, fmt FROM c, (VALUES {_FMTS}) f(fmt) WHERE NOT (fmt='glm4' AND two)),
sound AS (SELECT * FROM live WHERE {h("'bad:'||id||':'||fmt")} % 11 <> 0)"""


@query("tool_call_extract", f"""WITH {CALL_SQL}, {_LIVE}
SELECT id, fmt, 0::BIGINT AS call_idx, 'lookup'||CASE fmt WHEN 'seed_oss' THEN '>' ELSE '' END AS name, {_ONE[1]} AS arguments FROM sound
UNION ALL SELECT id, fmt, 1, 'scan'||CASE fmt WHEN 'seed_oss' THEN '>' ELSE '' END, {_TWO[1]} FROM sound WHERE two""")
def tool_call_extract(spark, folder):
    found, _ = T.calls_table(damaged(spark, folder), "text", F.col("fmt"), ["id", "fmt"])
    return found.withColumn("call_idx", F.col("call_idx").cast("bigint"))


@query("tool_usage_stats", f"""WITH {CALL_SQL}, {_LIVE}, good AS (
  SELECT fmt, count(*) AS ok, count(*) FILTER (two) AS twos FROM sound GROUP BY fmt)
SELECT fmt, count(*)::BIGINT AS texts, (count(*)-max(ok))::BIGINT AS failed, round((count(*)-max(ok))/count(*)::DOUBLE,6) AS failure_rate,
       max(ok)::BIGINT AS lookup_calls, max(twos)::BIGINT AS scan_calls FROM live JOIN good USING (fmt) GROUP BY fmt""")
def tool_usage_stats(spark, folder):
    out = T.usage_stats(damaged(spark, folder), "text", F.col("fmt"), ["fmt"])
    calls = [F.coalesce(F.sum(F.when(F.col("name").startswith(n), F.col("calls"))), F.lit(0)).alias(f"{n}_calls") for n in ("lookup", "scan")]
    return out.groupBy("fmt", "texts", "failed", F.round("failure_rate", 6).alias("failure_rate")).agg(*calls)


def exam(spark, folder):
    """Multiple-choice rows from the documents: the text is the question, choices and answer come from hashes."""
    rows = X.table(spark, folder, "documents").select(F.col("doc_id").alias("qid"), F.concat(
        F.lit("subject_"), (X.tag("subj", "doc_id") % 8).cast("string")).alias("subject"), F.col("text").alias("question"),
        *[F.substring(F.md5(F.concat(F.lit(c), F.col("doc_id").cast("string"))), 1, 8).alias(c) for c in M.CHOICES],
        F.get(F.array(*[F.lit(c) for c in M.CHOICES]), (X.tag("ans", "doc_id") % 4).cast("int")).alias("answer"),
        (X.tag("tr", "doc_id") % 4 == 0).alias("train"))
    return rows.filter("not train").drop("train"), rows.filter("train").drop("train")


EXAM = f"""exam AS (
  SELECT doc_id AS qid, 'subject_'||({h("'subj:'||doc_id")} % 8) AS subject, text AS question,
    substr(md5('A'||doc_id),1,8) AS a, substr(md5('B'||doc_id),1,8) AS b, substr(md5('C'||doc_id),1,8) AS c, substr(md5('D'||doc_id),1,8) AS d,
    ['A','B','C','D'][{h("'ans:'||doc_id")} % 4 + 1] AS answer, {h("'tr:'||doc_id")} % 4 = 0 AS train FROM documents),
asked AS (SELECT *, question||chr(10)||'A. '||a||chr(10)||'B. '||b||chr(10)||'C. '||c||chr(10)||'D. '||d||chr(10)||'Answer:' AS q FROM exam)"""


@query("mcq_prompt", f"""WITH {EXAM}, sup AS (
  SELECT *, row_number() OVER (PARTITION BY subject ORDER BY {h("'0:'||qid")}, qid) - 1 AS at, count(*) OVER (PARTITION BY subject) AS n
  FROM asked WHERE train),
shots AS (
  SELECT t.qid, k, s.q, s.answer FROM asked t, (VALUES (0),(1),(2)) v(k), sup s
  WHERE NOT t.train AND s.subject=t.subject AND k < s.n AND s.at = ({h("'0:'||t.qid")} + k) % s.n),
ex AS (SELECT qid, string_agg('user='||q||'|assistant='||answer||'|','' ORDER BY k) AS e FROM shots GROUP BY qid)
SELECT t.qid, t.subject, 'user=The following are multiple choice questions (with answers) about '||t.subject||'.'||chr(10)||chr(10)
  || coalesce(substr(e, 6)||'user=','')||t.q||'|assistant='||t.answer AS messages
FROM asked t LEFT JOIN ex USING (qid) WHERE NOT t.train""")
def mcq_prompt(spark, folder):
    test, train = exam(spark, folder)
    out = M.mcq_prompt(test, train, 3)
    return out.select("qid", "subject", F.array_join(F.transform("messages", lambda m: F.concat_ws("=", m["role"], m["content"])), "|").alias("messages"))


@query("judge_prompt", f"""WITH {X.PREFS}
SELECT id, {lit(RUBRIC).replace('{question}', "'||prompt||'").replace('{answer1}', "'||chosen||'").replace('{answer2}', "'||rejected||'")} AS query FROM prefs""")
def judge_prompt(spark, folder):
    rows = X.preferences(spark, folder)
    base = rows.select("id", F.col("chosen").alias("output"))
    answers = rows.select("id", F.col("prompt").alias("question"), F.col("rejected").alias("response"))
    return fill_rubric(base, answers, "id")


@query("stop_words", f"""WITH {template_values(NAMES)}
SELECT DISTINCT conv_id, name AS template, stops AS words FROM conversations JOIN t ON t.idx = {h("'tpl:'||conv_id")} % {len(NAMES)}""")
def stop_words(spark, folder):
    ids = X.table(spark, folder, "conversations").select("conv_id").distinct()
    joined = named(ids, NAMES).join(F.broadcast(template_table(spark).withColumnRenamed("name", "template")), "template")
    return joined.select("conv_id", "template", F.array_join(stops({"eos": F.col("eos"), "stop_words": F.col("stop_words")}), "|").alias("words"))


@query("align_preference_csv", f"""WITH {X.PREFS}
SELECT id, prompt AS raw_prompt, '<|im_start|>user'||chr(10)||prompt||'<|im_end|>'||chr(10)||'<|im_start|>assistant'||chr(10) AS prompt, chosen, rejected FROM prefs""")
def align_preference_csv(spark, folder):
    rows = X.preferences(spark, folder).withColumnRenamed("prompt", "raw_prompt")
    asked = F.array(A.message("user", F.col("raw_prompt")))
    text = F.array_join(R.render_turns(asked, F.lit(""), template("chatml"), name="chatml"), "")
    return rows.select("id", "raw_prompt", text.alias("prompt"), "chosen", "rejected")
