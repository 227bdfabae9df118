r"""Chat formatting with a grammar round trip.

    conversation := turn*
    turn         := "### " role ": " body "</turn>\n"
    role         := characters other than ":" and "\", or escapes
    body         := text without "### " and "</turn>", or escapes
    escape       := "\" any character, read as that character

A turn is first rendered as it is. It is parsed again; while the parse fails or differs from the source, it is rendered
with more escapes: each "\" doubled, a "\" set inside each control string, and before ":" in roles; then a "\" before
every character. A turn that still differs is an error, as the grammar must hold. The parser reads a whole conversation:
it splits at turn ends, reads each piece by the grammar and takes escapes off. Its patterns don't backtrack, so texts and
roles may be of any length, and spans are summed up in one pass.

Cases: null text and null role are empty; turns sort by (turn, role, text), nulls first, so ties and repeated rows
have a fixed order and all stay; rows with a null conv_id form one conversation; an empty table gives no rows but those
added; other columns are ignored. A conversation becomes one string, so it must fit one task; nothing else is grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, END = "### ", "</turn>"
TURN = r"(?s)^### ((?:[^:\\]++|\\.)*+): (.*+)$"
#: A conversation added to those of the table: its texts hold the template's own control strings.
EXTRA = ((-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok"))


def escape_body(x: Column) -> Column:
    doubled = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("</turn>"), F.lit("<\\/turn>")), F.lit("### "), F.lit("#\\## "))


def escape_role(x: Column) -> Column:
    return F.replace(escape_body(x), F.lit(":"), F.lit("\\:"))


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def _rendered(role: Column, body: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(": "), body, F.lit(END + "\n"))


def parse_turn(piece: Column) -> Column:
    """One piece, without its end -> struct(role, body, text), null where the grammar does not fit."""
    role, body = F.regexp_extract(piece, TURN, 1), F.regexp_extract(piece, TURN, 2)
    fits = piece.rlike(TURN) & ~body.contains(HEAD) & ~body.contains(END)
    return F.when(fits, F.struct(unescape(role).alias("role"), body.alias("body"), unescape(body).alias("text")))


def parse(formatted: Column) -> Column:
    """A whole conversation -> array of struct(role, body, text)."""
    pieces = F.split(formatted, END + "\n")
    return F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), parse_turn)


def escape_all(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)(.)", r"\\$1")


def render_turn(role: Column, text: Column) -> Column:
    """The first rendering that the parser reads back as the source."""

    def same(out: Column) -> Column:
        back = parse(out)
        return (F.size(back) == 1) & F.coalesce((back[0]["role"] == role) & (back[0]["text"] == text), F.lit(False))

    plain, escaped, every = _rendered(role, text), _rendered(escape_role(role), escape_body(text)), _rendered(escape_all(role), escape_all(text))
    return F.when(same(plain), plain).when(same(escaped), escaped).when(same(every), every).otherwise(F.raise_error(F.lit("a turn does not survive the round trip")))


def format_chat(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, formatted, loss_spans [(start, length) in characters of formatted].

    The spans cover the bodies of ``trained`` turns, as the parser finds them.
    """
    t = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("out", render_turn(F.col("role"), F.col("text")))
    # ends of turns in the conversation: the window and the grouping share one shuffle
    line = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("end", F.sum(F.length("out")).over(line))
    body = F.length(F.regexp_extract(F.substring_index("out", END + "\n", 1), TURN, 2)).cast("long")
    span = F.when(F.col("role") == trained, F.struct((F.col("end") - len(END) - 1 - body).alias("start"), body.alias("length")))
    c = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "end", "out", span.alias("span")))).alias("turns"))
    spans = F.filter(F.transform("turns", lambda x: x["span"]), lambda x: x.isNotNull())
    return c.select("conv_id", F.array_join(F.transform("turns", lambda x: x["out"]), "").alias("formatted"), spans.alias("loss_spans"), F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"))


def op9(spark, sf_dir) -> DataFrame:
    from .common import read

    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(list(EXTRA), "conv_id long, turn long, role string, text string"))
    c = format_chat(turns).withColumn("back", parse(F.col("formatted")))
    whole = F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    c = c.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), F.coalesce(F.transform("back", lambda x: F.struct(x["role"], x["text"])) == F.transform("source", lambda x: F.struct(x["role"], x["text"])), F.lit(False)).alias("identical"))
    return c.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "identical")


OP9_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
r AS (SELECT *, CASE WHEN contains(text, '### ') OR contains(text, '</turn>') OR regexp_matches(text, '(?s)\\.') OR contains(role, ':') OR contains(role, '\') OR contains(role, '### ') OR contains(role, '</turn>')
  THEN '### ' || replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## '), ':', '\:') || ': ' || replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## ') || '</turn>' || chr(10)
  ELSE '### ' || role || ': ' || text || '</turn>' || chr(10) END AS out FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(out))::BIGINT AS formatted_chars, true AS identical
FROM r GROUP BY conv_id
"""
