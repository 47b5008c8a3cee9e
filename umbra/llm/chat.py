"""Chat formatting from logs of events: fold each conversation's events into messages, render them, and read them back.

Events are rows (conversation, seq, turn, kind, role, text):
- `message`  sets a turn's role and text;
- `delta`    adds streamed text at the end of the turn;
- `edit`     replaces the turn's text by a new one;
- `append`   adds a whole message of its own, also where the turn has one;
- `regenerate` throws the turn's text away and every later turn with it; deltas of the new answer follow.

Nulls: text counts as empty, a null kind as `message`, a null role as an empty role (an event without a role leaves the
turn's role as it is), a null turn sorts first. Repeated rows are events of their own. Ties in `seq` go by kind, role and
text. A null conversation is a conversation like any other.

Rendering: `<|im_start|>role\\ntext<|im_end|>\\n` for each turn. Texts and roles cannot hold a control string: a backslash
becomes `\\s` and `<|` becomes `<\\p`, and a line break in a role `\\n`; reading back turns `\\p` into `|` and then `\\s`
into a backslash. Very long texts are as any other, in time that grows with the conversation. Of a table only the six columns are read; others
are left out of the results, so their names don't matter. Built-in SQL functions only. A conversation becomes one row, as its rendered text is one string; hence its
events meet in one task, but events of other conversations needn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from umbra.llm.spans import blocks, piece, running

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"
RESETS = ("message", "edit", "regenerate")
TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<|"), F.lit("<\\p"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\p"), F.lit("|")), F.lit("\\s"), F.lit("\\"))


def messages(events: DataFrame, conv: str = "conv_id", seq: str = "seq") -> DataFrame:
    """One row a conversation: `conv` and `turns`, array of (turn, role, text) in order.

    An event counts unless a later `message`, `edit` or `regenerate` of its turn, or a later `regenerate` of an earlier turn,
    took its place. So each turn needs its own last reset and the last regeneration before it: a grouping by turn, a
    running maximum along the conversation, and no replay of the log in one place.
    """
    event = F.struct(F.col(seq).alias("seq"), F.coalesce("kind", F.lit("message")).alias("kind"), F.col("role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    log = events.select(F.col(conv).alias("__conv"), F.col("turn").cast("bigint").alias("__turn"), event.alias("e"))
    by_turn = log.groupBy("__conv", "__turn").agg(
        F.array_sort(F.collect_list("e")).alias("events"),
        F.max(F.when(F.col("e.kind").isin(*RESETS), F.col("e"))).alias("reset"),
        F.max(F.when(F.col("e.kind") == "regenerate", F.col("e"))).alias("again"),
    )
    before = W.partitionBy("__conv").orderBy("__turn").rowsBetween(W.unboundedPreceding, -1)
    ruled = by_turn.withColumn("again", F.max("again").over(before))
    live = F.filter("events", lambda e: (F.col("again").isNull() | (e > F.col("again"))) & (F.col("reset").isNull() | (e >= F.col("reset")) | (e["kind"] == "append")))
    kept = ruled.select("__conv", "__turn", "events", live.alias("live"))
    parts = F.filter("live", lambda e: e["kind"] != "append")
    role = F.element_at(F.filter(F.transform("events", lambda e: F.when(e["kind"] != "append", e["role"])), lambda r: r.isNotNull()), -1)
    turn = lambda role, text: F.struct(F.col("__turn").alias("turn"), role.alias("role"), text.alias("text"))
    own = F.when(F.size(parts) > 0, F.array(turn(F.coalesce(F.when(F.exists("events", lambda e: (e["kind"] != "append") & e["role"].isNotNull()), role), F.lit("")), F.array_join(F.transform(parts, lambda e: e["text"]), "")))).otherwise(F.array().cast(TURNS))
    added = F.transform(F.filter("live", lambda e: e["kind"] == "append"), lambda e: turn(F.coalesce(e["role"], F.lit("")), e["text"]))
    made = kept.select("__conv", "__turn", F.concat(own, added.cast(TURNS)).alias("made"))
    together = made.groupBy("__conv").agg(F.array_sort(F.collect_list(F.struct("__turn", "made"))).alias("all"))
    return together.select(F.col("__conv").alias(conv), F.flatten(F.transform("all", lambda t: t["made"])).alias("turns"))


def render(conversations: DataFrame) -> DataFrame:
    """Adds `formatted` and `loss_spans`, the (start, end) in code points of the text under the loss mask.

    Each turn renders to a piece of its own; running sums of the pieces' lengths place the spans, in time that grows with the
    conversation.
    """
    piece = lambda t: F.concat(F.lit(OPEN), F.replace(escaped(t["role"]), F.lit("\n"), F.lit("\\n")), F.lit("\n"), escaped(t["text"]), F.lit(CLOSE))
    names = [F.col(f"`{c}`") for c in conversations.columns]
    cut = conversations.select(*names, F.transform("turns", lambda t: F.struct(t["role"].alias("role"), piece(t).alias("piece"), F.length(escaped(t["text"])).alias("n"))).alias("__pieces"))
    sized = cut.select(*names, "__pieces", F.transform("__pieces", lambda p: F.length(p["piece"]).cast("bigint")).alias("__lengths"))
    placed = sized.select(*names, "__pieces", running(F.col("__lengths"), "array<bigint>", lambda a, x: a + x).alias("__ends"))
    trained = F.filter(F.arrays_zip(F.col("__pieces").alias("p"), F.col("__ends").alias("end")), lambda x: x["p"]["role"] == TRAINED)
    spans = F.transform(trained, lambda x: F.struct((x["end"] - len(CLOSE) - x["p"]["n"]).alias("start"), (x["end"] - len(CLOSE)).alias("end")))
    return placed.select(*names, F.array_join(F.transform("__pieces", lambda p: p["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(rendered: DataFrame) -> DataFrame:
    """From `formatted` and `loss_spans` alone: `read_turns`, array of (role, text), and `read_loss`, the text under the mask."""
    parts = F.filter(F.split("formatted", F.lit(r"<\|im_start\|>"), -1), lambda p: p != "")
    split_turn = lambda p: F.struct(
        unescaped(F.replace(F.substring_index(p, "\n", 1), F.lit("\\n"), F.lit("\n"))).alias("role"),
        unescaped(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 1 - len(CLOSE))).alias("text"),
    )
    names = [F.col(f"`{c}`") for c in rendered.columns]
    blocked = rendered.select(*names, F.transform(parts, split_turn).alias("read_turns"), blocks(F.col("formatted")).alias("__blocks"))
    under = F.when(F.size("__blocks") > 0, F.array_join(F.transform("loss_spans", lambda s: unescaped(piece("__blocks", s["start"], s["end"]))), "")).otherwise(F.lit(""))
    return blocked.select(*names, "read_turns", under.alias("read_loss"))


#: Characters of a streamed piece.
STREAM = 64


def streamed(rows: DataFrame) -> DataFrame:
    """The log of events (conv_id, seq, turn, kind, role, text) of a service in which rows (conv_id, turn, role, text) came about.

    An assistant's turn starts empty, streams a first answer, is regenerated, and streams the final one in pieces; any other turn is
    sent with a draft, its text backwards, and edited. Rows of a conversation that repeat a turn are turns of their own, by role and text.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = rows.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))}).withColumn("turn", F.row_number().over(order).cast("bigint") - 1)
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{STREAM}}}"), F.lit(0))
    event = lambda kind, role, text: F.struct(F.lit(kind).alias("kind"), role.cast("string").alias("role"), text.alias("text"))
    none, nothing = F.lit(None), F.lit("")
    deltas = lambda xs: F.transform(xs, lambda x: event("delta", none, x))
    answer = F.concat(F.array(event("message", F.col("role"), nothing)), deltas(F.reverse(F.slice(pieces, 1, 2))), F.array(event("regenerate", none, nothing)), deltas(pieces))
    other = F.array(event("message", F.col("role"), F.reverse("text")), event("edit", none, F.col("text")))
    log = turns.select("conv_id", "turn", F.posexplode(F.when(F.col("role") == TRAINED, answer).otherwise(other)).alias("at", "e"))
    return log.select("conv_id", (F.col("turn") * (1 << 32) + F.col("at")).alias("seq"), "turn", "e.kind", "e.role", "e.text")


def query(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    known = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    # The table has messages only, so a log of deltas, edits and regenerations that ends in them is made first, and folded.
    done = read_back(render(messages(streamed(known.unionByName(extra)))))
    digest = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("read_turns").cast("bigint").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("read_loss").cast("bigint").alias("loss_chars"),
        F.sha2("read_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


#: Replays the contract without the template: only the length of the rendered text follows from its markers and escapes.
ORACLE_SQL = r"""
WITH log AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(replace(replace(role, '\', '\s'), '<|', '<\p')) + 1 + length(replace(replace(text, '\', '\s'), '<|', '<\p')) + 11)::BIGINT AS formatted_chars
FROM log GROUP BY conv_id
"""
