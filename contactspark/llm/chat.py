"""Chat formatting with a grammar that is read back, in built-in functions only.

Grammar:  conversation = turn*          turn = "<s>[INST]" flag " " role " [/INST]" text "</s>"
          flag = "" | "\\"              role, text: strings without a control string

A turn is first rendered as it is and read back by the parser. Where the recovered turn is not the
source, for instance as a text holds a control string, the turn is rendered again with the flag set
and its role and text escaped: each backslash is doubled and each control string gets a backslash
after its first character. The flag tells the parser to undo that. The assembled conversation is read back, too,
and its turns are compared with the source by a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import between, blocks, let

START, END, OPEN, CLOSE = CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
FLAG = "\\"


def escaped(c: Column) -> Column:
    c = F.replace(c, F.lit(FLAG), F.lit(FLAG * 2))
    for s in CONTROL:
        c = F.replace(c, F.lit(s), F.lit(s[0] + FLAG + s[1:]))
    return c


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def render(role: Column, text: Column, flag: str = "") -> Column:
    if flag:
        role, text = escaped(role), escaped(text)
    return F.concat(F.lit(f"{START}{OPEN}{flag} "), role, F.lit(f" {CLOSE}"), text, F.lit(END))


def parse_turn(piece: Column) -> Column:
    """Struct of role, text and raw text of what stands before a turn's end mark; null if it isn't by the grammar."""
    flagged = F.startswith(piece, F.lit(f"{START}{OPEN}{FLAG} "))
    good = flagged | F.startswith(piece, F.lit(f"{START}{OPEN} "))
    inner = F.substring(piece, F.lit(len(START + OPEN) + 2) + flagged.cast("int"), F.length(piece))
    parts = F.split(inner, r" \[/INST\]", 2)
    role, raw = F.get(parts, 0), F.get(parts, 1)
    for s in CONTROL:
        good &= ~F.contains(inner, F.lit(s)) if s != CLOSE else ~F.contains(role, F.lit(s)) & ~F.contains(raw, F.lit(s))
    undo = lambda c: F.when(flagged, unescaped(c)).otherwise(c)
    return F.when(good, F.struct(undo(role).alias("role"), undo(raw).alias("text"), raw.alias("raw"), flagged.alias("flagged")))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation."""
    pieces = F.split(formatted, END, -1)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), parse_turn)


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", train_on: str = "assistant") -> DataFrame:
    """One row a conversation: conv, formatted, and loss_spans, an array of (start, end, flagged) in code
    points, end exclusive: the texts of the role to train on as they stand in formatted.

    Turns go by `turn` (null first), then role, then text, so ties and repeated rows have one order and all
    stay. Null roles and texts are empty. Rows with a null conversation id form one conversation. Other
    columns are not kept. An empty table gives no rows.
    """
    rows = df.select(F.col(conv).alias("c"), F.col(turn).alias("n"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x"))

    def recovered(rendered: Column) -> Column:
        turns = parse(rendered)
        back = F.get(turns, 0)
        return F.coalesce((F.size(turns) == 1) & (back["role"] == F.col("r")) & (back["text"] == F.col("x")), F.lit(False))

    plain, safe = render(F.col("r"), F.col("x")), render(F.col("r"), F.col("x"), FLAG)
    rows = rows.withColumn("flagged", ~recovered(plain))
    rows = rows.withColumn("shown", F.when(~F.col("flagged"), plain).when(recovered(safe), safe).otherwise(F.raise_error(F.lit("a turn cannot be read back"))))
    order = Window.partitionBy("c").orderBy("n", "r", "x")
    rows = rows.withColumn("at", F.sum(F.length("shown").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    end = F.col("at") - len(END)
    body = F.when(F.col("flagged"), F.length(escaped(F.col("x")))).otherwise(F.length("x"))
    span = F.when(F.col("r") == train_on, F.struct((end - body).alias("start"), end.alias("end"), F.col("flagged")))
    source = F.xxhash64("r", "x").alias("source")
    turns = rows.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("at", "shown", span.alias("span"), source))).alias("t"))
    turns = turns.withColumn("whole", F.array_join(F.transform("t", lambda x: x["shown"]), ""))
    same = F.transform(parse(F.col("whole")), lambda x: F.xxhash64(x["role"], x["text"])) == F.transform("t", lambda x: x["source"])
    spans = F.filter(F.transform("t", lambda x: x["span"]), lambda s: s.isNotNull())
    checked = F.when(same, F.col("whole")).otherwise(F.raise_error(F.lit("a conversation cannot be read back")))
    return turns.select(F.col("c").alias(conv), checked.alias("formatted"), spans.alias("loss_spans"))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped."""

    def of(parts: Column, s: Column) -> Column:
        raw = between(parts, s["start"], s["end"])
        return F.when(s["flagged"], unescaped(raw)).otherwise(raw)

    return let(blocks(formatted), lambda parts: F.array_join(F.transform(spans, lambda s: of(parts, s)), ""))


SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f as (select *, regexp_matches(role || ' ' || text, '</?s>|\[/?INST\]') as flagged from c),
e as (select *, length(role) + length(text)
          + case when flagged then 1 + length(regexp_replace(role || ' ' || text, '[^\\]', '', 'g'))
              + len(regexp_extract_all(role || ' ' || text, '</?s>|\[/?INST\]')) else 0 end
          + length('<s>[INST]  [/INST]</s>') as shown from f)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(shown)::bigint as formatted_chars
from e group by conv_id
"""
