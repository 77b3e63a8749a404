r"""Chat formatting by event-sourced reconstruction.

A log of events (conv, seq, kind, turn, role, text) is folded into messages and
rendered. `message` opens a message with its text, `delta` adds to the turn's
last message, `edit` replaces its text, `regenerate` empties it so that later
deltas build it anew; an event that meets no message opens one.

The fold is linear: counts over a turn's events in the order of seq tell which
message an event belongs to and how many resets of it come before, so what a
later reset undoes is dropped before any text is put together, and the deltas
that stay are joined once. Events of one turn are sorted by one task, which may
spill; a conversation's messages then meet in one row, as its formatted text
has to be one.

Template: `<|im_start|>role\ntext<|im_end|>\n` for each turn. In texts and roles
`\` becomes `\\` and `<|` becomes `<\|`, in roles a line feed becomes `\n`; no
control string can then arise from a text, and unescape() gives it back.

Defined cases: null role and text are empty; a null conv or turn is a value of
its own and sorts first; events of any other kind, or of none, change nothing
and open nothing, and unknown_events() returns them; events equal in seq sort by kind as listed, then role,
then text, and repeated rows are events each; an empty log gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import take

START, END = "<|im_start|>", "<|im_end|>"
PROBE = f"{END}{START}assistant ok"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


KINDS = ("message", "edit", "regenerate", "delta")


def unknown_events(log: DataFrame) -> DataFrame:
    """The events that fold_events() leaves aside: those of a kind it doesn't know."""
    return log.where(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)))


def fold_events(log: DataFrame) -> DataFrame:
    """conv, turns: array of (turn, role, text) in the order of turn."""
    e = take(log, "conv", "seq", "kind", "turn", "role", "text").where(F.col("kind").isin(*KINDS))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    e = e.select("conv", "turn", "seq", rank.alias("rank"), F.coalesce("role", F.lit("")).alias("role"), F.when(rank == 3, "").otherwise(F.coalesce("text", F.lit(""))).alias("text"))
    order = Window.partitionBy("conv", "turn").orderBy("seq", "rank", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumns({"i": F.row_number().over(order), "message": F.count_if(F.col("rank") == 1).over(upto), "reset": F.count_if(F.col("rank") < 4).over(upto)})
    whole = Window.partitionBy("conv", "turn", "message").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    e = e.withColumns({"role": F.first("role").over(whole), "last": F.max("reset").over(whole)}).where("reset = last")
    parts = F.sort_array(F.collect_list(F.struct("i", "text")))
    said = e.groupBy("conv", "turn", "message", "role").agg(F.array_join(parts["text"], "").alias("text"))
    turns = said.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "message", "role", "text"))).alias("t"))
    return turns.select("conv", F.transform("t", lambda m: F.struct(m["turn"].alias("turn"), m["role"].alias("role"), m["text"].alias("text"))).alias("turns"))


def render(chats: DataFrame) -> DataFrame:
    """conv, formatted, loss_spans: array of (start, end), the code points of the assistant's escaped texts."""
    parts = chats.select("conv", F.transform("turns", lambda x: F.struct(
        F.concat(F.lit(START), F.replace(escape(x["role"]), F.lit("\n"), F.lit("\\n")), F.lit("\n")).alias("head"), escape(x["text"]).alias("body"), (x["role"] == "assistant").alias("loss"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(f"{END}\n"))), "")
    starts = _starts(F.transform("parts", lambda p: F.char_length(p["head"]) + F.char_length(p["body"]) + len(END) + 1))
    span = lambda p, at: F.when(p["loss"], F.struct((at + F.char_length(p["head"])).alias("start"), (at + F.char_length(p["head"]) + F.char_length(p["body"])).alias("end")))
    return parts.select("conv", text.alias("formatted"), F.filter(F.zip_with("parts", starts, span), lambda x: x.isNotNull()).alias("loss_spans"))


def _starts(sizes: Column) -> Column:
    """The running sum before each element. Arrays only grow by copying, so a block of 256 elements is summed at a time."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / 256).cast("int")), lambda k: F.slice(sizes, k * 256 + 1, F.lit(256)))
    none, nones = F.lit(None).cast("array<int>"), F.lit(None).cast("array<array<int>>")
    grown = lambda held, new: F.concat(F.coalesce(held, F.array().cast("array<int>")), F.array(new))
    inner = lambda block, at: F.aggregate(block, F.struct(at.alias("at"), none.alias("s")), lambda a, n: F.struct((a["at"] + n).alias("at"), grown(a["s"], a["at"]).alias("s")))
    step = lambda acc, block: F.struct((acc["at"] + F.aggregate(block, F.lit(0), lambda x, y: x + y)).alias("at"), F.concat(F.coalesce(acc["s"], F.array().cast("array<array<int>>")), F.array(inner(block, acc["at"])["s"])).alias("s"))
    return F.flatten(F.aggregate(blocks, F.struct(F.lit(0).alias("at"), nones.alias("s")), step)["s"])


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>", -1), 2, 1 << 30)

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        body = F.substring(p, F.char_length(head) + 2, F.char_length(p) - F.char_length(head) - F.lit(len(END) + 2))
        role = F.array_join(F.transform(F.split(head, r"\\\\", -1), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\\\")
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def as_events(rows: DataFrame) -> DataFrame:
    """A log whose fold gives back rows(conv, turn, role, text), each a message: an assistant's comes as a draft that is regenerated, then as three deltas; another's is sent short and edited. Rows of one turn follow each other by role and text."""
    nth = F.row_number().over(Window.partitionBy("conv", "turn").orderBy(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))))
    said = F.coalesce("text", F.lit(""))
    third = F.floor(F.char_length(said) / 3).cast("int")
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    streamed = [event("message", F.lit("")), event("delta", F.concat(F.lit("Draft: "), F.substring(said, F.lit(1), third))), event("regenerate", F.lit(None).cast("string"))]
    streamed += [event("delta", F.substring(said, third * k + 1, third if k < 2 else F.char_length(said))) for k in range(3)]
    edited = [event("message", F.substring(said, F.lit(1), third)), event("edit", said)]
    events = F.when(F.col("role") == "assistant", F.array(*streamed)).otherwise(F.array(*edited))
    log = rows.withColumn("nth", nth).select("conv", "turn", "role", "nth", F.posexplode(events).alias("step", "event"))
    return log.select("conv", (F.col("nth") * 10 + F.col("step")).cast("long").alias("seq"), "event.kind", "turn", "role", "event.text")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as a log of streamed, regenerated and edited messages, folded, rendered and read back."""
    rows = take(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "role", "text")
    probe = spark.sql(f"SELECT -1L AS conv_id, cast(t AS bigint) AS turn, r AS role, '{PROBE}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS v(t, r)")
    log = as_events(rows.unionByName(probe).withColumnRenamed("conv_id", "conv"))
    out = render(fold_events(log)).select("conv", "formatted", "loss_spans", parse(F.col("formatted")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    out = out.select("conv", "formatted", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), loss.alias("loss"))
    return out.select(F.col("conv").alias("conv_id"), "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
           SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
e AS (SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS et, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS er FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
      coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
      sum(length('{START}') + length(er) + 1 + length(et) + length('{END}') + 1)::BIGINT AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
