"""Chat formatting as relational algebra: turn structs are collected and sorted, neighbours of one role become a block by
array functions, and blocks are concatenated. Spark expressions only.

A block is ``### role: text</turn>`` and a newline; the texts of a block that holds several turns have ``<next>`` between
them, so the turns can be read back. Texts may hold anything: a backslash is written ``\\b``, the ``#`` of ``###`` is
written ``\\h`` and the ``<`` of a mark ``\\l``; in a role every ``#``, ``<`` and ``:`` is (``\\c`` for a colon). Escaped text never
holds ``###`` or a mark, so reading is splitting at marks and undoing the three replacements.

The loss mask is one pair of lengths per turn: so many code points are skipped (marks, and texts of other roles), then so
many are learnt. It grows with the turns only and is read in one pass.

Defined cases: null text and null role are empty; null turns come first; rows with equal turn numbers are ordered by role, then
text, and repeated rows are turns of their own; rows with a null conversation id are one conversation. An empty table gives
no rows. Extra columns are ignored. A conversation is one output row, so its turns meet in one task; every step over
them is linear.
"""

from pyspark.sql import Column, DataFrame, functions as F

from prefmill.functions.numeric import let

HEAD, AFTER, NEXT, END = "### ", ": ", "<next>", "</turn>\n"
LEARNT = ("assistant",)


def escaped(text: Column) -> Column:
    text = F.regexp_replace(text, r"\\", r"\\b")
    return F.regexp_replace(F.regexp_replace(text, "#(?=##)", r"\\h"), "<(?=/turn>|next>)", r"\\l")


def escaped_role(role: Column) -> Column:
    for sign, code in (("\\", "b"), ("#", "h"), ("<", "l"), (":", "c")):
        role = F.replace(role, F.lit(sign), F.lit("\\" + code))
    return role


def unescaped(text: Column) -> Column:
    """Undo ``escaped`` and ``escaped_role``: every backslash begins a code, so the order only matters for the last."""
    for code, sign in (("\\h", "#"), ("\\l", "<"), ("\\c", ":"), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def turns(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, turns: array of (turn, role, text) in order, with escaped role and text."""
    cells = rows.select(key, F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("cell"))
    grouped = cells.groupBy(key).agg(F.array_sort(F.collect_list("cell")).alias("turns"))
    return grouped.select(key, F.transform("turns", lambda t: F.struct(
        t["turn"].alias("turn"), escaped_role(t["role"]).alias("role"), escaped(t["text"]).alias("text"),
        t["role"].isin(*LEARNT).alias("learnt"))).alias("turns"))


def blocks(of: Column) -> Column:
    """Array of (role, learnt, texts): one element for each stretch of neighbours with the same role."""
    n = F.size(of)
    heads = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(of, i)["role"] != F.get(of, i - 1)["role"]))

    def block(starts):
        return F.transform(starts, lambda s, j: F.struct(
            F.get(of, s)["role"].alias("role"), F.get(of, s)["learnt"].alias("learnt"),
            F.transform(F.slice(of, s + 1, F.coalesce(F.get(starts, j + 1), n) - s), lambda t: t["text"]).alias("texts")))
    return let(heads, block)


def formatted(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, formatted, mask (array of skip, take), one row per conversation."""
    held = turns(rows, key).select(key, let(F.col("turns"), blocks).alias("blocks"))
    text = F.array_join(F.transform("blocks", lambda b: F.concat(
        F.lit(HEAD), b["role"], F.lit(AFTER), F.array_join(b["texts"], NEXT), F.lit(END))), "")

    def cells(b, i):
        before = F.char_length(b["role"]) + len(HEAD + AFTER) + F.when(i > 0, len(END)).otherwise(0)
        return F.transform(b["texts"], lambda t, k: F.struct(
            F.when(k == 0, before).otherwise(len(NEXT)).cast("long").alias("lead"), F.char_length(t).cast("long").alias("size"),
            b["learnt"].alias("learnt")))
    mask = F.transform(F.flatten(F.transform("blocks", cells)), lambda c: F.struct(
        (c["lead"] + F.when(c["learnt"], 0).otherwise(c["size"])).alias("skip"), F.when(c["learnt"], c["size"]).otherwise(0).alias("take")))
    return held.select(key, text.alias("formatted"), mask.alias("mask"))


def read(of: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, formatted, turns: array of (role, text, learnt) read back from the formatted text and its mask; learnt is null
    for what the mask skips, else the text under it. Fails if the mask and the marks do not meet."""
    pieces = F.split(F.col("formatted"), END)
    bodies = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def parts(body, i):
        """Role, lead and escaped texts of a block. A role holds no colon, so the first ``: `` ends it."""
        role = F.substring_index(body, AFTER, 1)
        at = F.char_length(role) + len(AFTER)
        return let(F.struct(role.alias("role"), F.split(body.substr(at + 1, F.char_length(body)), NEXT).alias("texts"), at.alias("at")),
                   lambda p: F.transform(p["texts"], lambda t, k: F.struct(
                       unescaped(p["role"].substr(F.lit(len(HEAD) + 1), F.char_length(p["role"]))).alias("role"), t.alias("text"),
                       F.when(k == 0, p["at"] + F.when(i > 0, len(END)).otherwise(0)).otherwise(len(NEXT)).alias("lead"))))

    def under(t, m):
        size = F.char_length(t["text"])
        inside = (m["take"] == size) & (m["skip"] == t["lead"])
        fits = inside | (m["take"] == 0) & (m["skip"] == t["lead"] + size)
        return F.struct(t["role"].alias("role"), unescaped(t["text"]).alias("text"), F.when(fits & inside, unescaped(t["text"])).when(
            ~F.coalesce(fits, F.lit(False)), F.raise_error(F.lit("the mask does not meet the marks")).cast("string")).alias("learnt"))
    found = F.flatten(F.transform(bodies, parts))
    return of.select(key, "formatted", F.zip_with(found, "mask", under).alias("turns"))


def digests(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the formatted text."""
    back = read(formatted(rows, key), key)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = back.select(key, "formatted", "turns", F.array_join(F.transform("turns", lambda t: t["learnt"]), "").alias("learnt"))
    return learnt.select(key, F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                         F.char_length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
                         F.char_length("formatted").cast("long").alias("formatted_chars"))


def with_probe(rows: DataFrame) -> DataFrame:
    """The conversations and conversation -7, whose texts are made of control strings."""
    probe = rows.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)


SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, lag(role) OVER w AS before,
    length(regexp_replace(replace(replace(replace(text, '\', '\b'), '</turn>', '\l/turn>'), '<next>', '\lnext>'), '##(#+)', '##\1\1', 'g'))
      AS size,
    length(replace(replace(replace(replace(role, '\', '\b'), '#', '\h'), '<', '\l'), ':', '\c')) AS head,
    row_number() OVER w AS i
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY i)) AS loss_sha256,
  CAST(sum(size + CASE WHEN before IS NULL OR before <> role THEN head + 14 ELSE 6 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""
