"""Chat formatting by a grammar round trip, in SQL functions only.

    conversation := "<chat:" level ">\\n" turn*
    turn         := "<turn>" role "\\n" text "</turn>"

The deterministic parser takes what follows the header, splits it at
`</turn>`, drops `<turn>` before each piece and reads the role up to the first
line feed. A conversation is rendered at level 0 (as it is), reparsed and
compared; if a turn comes back changed, it is rendered at level 1, where `&`
becomes `&a` and `<` becomes `&l` inside roles and texts (line feeds inside
roles `&n`): after that no control string can stand inside a turn, so level 1
always comes back.

Nulls: a null text or role is empty; rows are ordered by turn, then role, then
text (null turns first), so ties have one order; repeated rows are turns of
their own; rows with a null conv_id make up one conversation. An empty table
gives no conversation. Further columns are passed by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE, LOSS_ROLE = "<turn>", "</turn>", "assistant"
HEADER = ("<chat:0>\n", "<chat:1>\n")


def _escape(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("&"), F.lit("&a")), F.lit("<"), F.lit("&l"))


def _unescape(s: Column) -> Column:
    return F.replace(F.replace(F.replace(s, F.lit("&l"), F.lit("<")), F.lit("&n"), F.lit("\n")), F.lit("&a"), F.lit("&"))


def _render(turns: Column, level: int) -> Column:
    role = (lambda t: F.replace(_escape(t["role"]), F.lit("\n"), F.lit("&n"))) if level else (lambda t: t["role"])
    text = (lambda t: _escape(t["text"])) if level else (lambda t: t["text"])
    parts = F.transform(turns, lambda t: F.concat(F.lit(OPEN), role(t), F.lit("\n"), text(t), F.lit(CLOSE)))
    return F.concat(F.lit(HEADER[level]), F.array_join(parts, ""))


def parse_raw(formatted: Column) -> Column:
    """The parser: array of (role, text) as they stand, still escaped, from a formatted conversation."""
    body = F.substring(formatted, len(HEADER[0]) + 1, F.length(formatted))
    pieces = F.split(body, CLOSE, -1)
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    inner = F.transform(pieces, lambda p: F.substring(p, len(OPEN) + 1, F.length(p)))
    cut = lambda p: F.instr(p, "\n")
    return F.transform(inner, lambda p: F.struct(F.substring(p, F.lit(1), cut(p) - 1).alias("role"), F.substring(p, cut(p) + 1, F.length(p)).alias("text")))


def parsed(formatted: Column) -> Column:
    """The turns as (role, text), unescaped by the level that the header names."""
    clean = F.transform(parse_raw(formatted), lambda t: F.struct(_unescape(t["role"]).alias("role"), _unescape(t["text"]).alias("text")))
    return F.when(formatted.startswith(HEADER[1]), clean).otherwise(parse_raw(formatted))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, n_source (its rows), level, formatted: one row for each conversation."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    convs = convs.withColumn("plain", _render(F.col("turns"), 0))
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    convs = convs.withColumn("level", F.when(parse_raw(F.col("plain")) == source, 0).otherwise(1))
    convs = convs.withColumn("formatted", F.when(F.col("level") == 0, F.col("plain")).otherwise(_render(F.col("turns"), 1)))
    back = F.assert_true(parsed(F.col("formatted")) == source, F.lit("a conversation did not come back"))
    return convs.select("conv_id", F.size("turns").alias("n_source"), "level", F.when(back.isNull(), F.col("formatted")).alias("formatted"))


def loss_mask(formatted: Column) -> Column:
    """Runs of the formatted string in order: (length, learn), code points; header and marks are not learnt."""
    runs = F.transform(
        parse_raw(formatted),
        lambda t: F.array(
            F.struct((F.length(t["role"]) + len(OPEN) + 1).alias("length"), F.lit(False).alias("learn")),
            F.struct(F.length(t["text"]).alias("length"), (t["role"] == LOSS_ROLE).alias("learn")),
            F.struct(F.lit(len(CLOSE)).alias("length"), F.lit(False).alias("learn")),
        ),
    )
    return F.concat(F.array(F.struct(F.lit(len(HEADER[0])).alias("length"), F.lit(False).alias("learn"))), F.flatten(runs))


#: What both turns of the conversation that the query adds say.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def op9_chat_formatting(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE)
    probe = spark.range(2).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(PROBE_TEXT).alias("text"))
    rows = rows.unionByName(probe)
    out = format_conversations(rows).select("conv_id", "formatted", "level")
    out = out.withColumn("turns", parsed(F.col("formatted")))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == LOSS_ROLE), lambda t: t["text"]), "")
    out = out.withColumn("loss", loss)
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha(digest).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        sha(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: Level 1 exactly when level 0 does not come back: a text or role holds `</turn>`, or a role a line feed.
ORACLE_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    max(CASE WHEN contains(text, '</turn>') OR contains(role, '</turn>') OR contains(role, chr(10)) THEN 1 ELSE 0 END) AS level,
    sum(length(role) + length(text) + 14) AS plain,
    sum(2 * (length(role) + length(text)) - length(replace(replace(role, '&', ''), '<', '')) - length(replace(replace(text, '&', ''), '<', ''))
      + length(role) - length(replace(role, chr(10), '')) + 14) AS escaped
  FROM rows GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  (9 + CASE WHEN level = 0 THEN plain ELSE escaped END)::BIGINT AS formatted_chars
FROM g
"""
