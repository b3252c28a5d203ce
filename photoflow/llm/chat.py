"""Chat formatting: conversations rebuilt from an event log, rendered with a template whose control strings texts can't forge.

Events are folded in two steps, both grouped: a message from its events in order of sequence, then a conversation from its
messages. A message's text is what follows its last reset (start, edit or regeneration), so folding is one join of strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: What the query's derived log streams at a time, in code points.
DELTA_CHARS = 400


def escape(c: Column) -> Column:
    """``<`` and ``|`` with k backslashes between get one more; so no ``<|`` is left, and :func:`unescape` is exact."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def messages(events: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Fold ``events(conv, seq, message_id, kind, role, text)`` into messages ``conv, at, role, text``, ``at`` their first seq.

    kind: ``start`` opens with a text that may be empty, ``delta`` adds to it, ``edit`` replaces it, ``regenerate`` drops
    it, for deltas to follow. Deltas before any reset count. The role is that of the last event that has one. Events
    of one seq are ordered by kind, role and text; other kinds are left out. Null texts are empty.
    """
    own = events.where("kind in ('start', 'delta', 'edit', 'regenerate')")
    event = F.struct("seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    own = own.groupBy(conv, "message_id").agg(F.sort_array(F.collect_list(event)).alias("e"))
    reset = F.filter(F.transform("e", lambda x, i: F.when(x["kind"] != "delta", i)), lambda i: i.isNotNull())
    own = own.select(conv, F.explode(F.array(F.struct("e", F.coalesce(F.array_max(reset), F.lit(0)).alias("from")))).alias("m"))
    rest = F.slice("m.e", F.col("m.from") + 1, F.greatest(F.size("m.e") - F.col("m.from"), F.lit(1)))
    text = F.array_join(F.transform(rest, lambda x: F.when(x["kind"] == "regenerate", "").otherwise(x["text"])), "")
    roles = F.filter(F.transform("m.e", lambda x: x["role"]), lambda r: r.isNotNull())
    return own.select(conv, F.get("m.e", F.lit(0))["seq"].alias("at"), F.coalesce(F.get(roles, F.size(roles) - 1), F.lit("")).alias("role"), text.alias("text"))


def formatted(msgs: DataFrame, conv: str = "conv_id", loss_role: str = "assistant") -> DataFrame:
    """``messages`` to ``conv, formatted, loss_spans``: the rendering, and [from, to) in code points of what the loss is on.

    The loss is on the escaped texts of ``loss_role``. Messages of one place are ordered by role and text. Line breaks
    in a role become ``<|nl|>``, which no escaped text holds.
    """
    turn = F.struct("at", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    df = msgs.groupBy(conv).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    parts = F.transform("t", lambda x: F.struct(F.concat(F.lit(START), F.replace(escape(x["role"]), F.lit("\n"), F.lit("<|nl|>")), F.lit("\n")).alias("head"), escape(x["text"]).alias("body"), (x["role"] == loss_role).alias("loss")))
    df = df.select(conv, F.explode(F.array(parts)).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(END + "\n"))), "")
    lengths = F.transform("p", lambda x: F.struct(F.length(x["head"]).alias("h"), F.length(x["body"]).alias("b"), x["loss"].alias("loss")))
    df = df.select(conv, text.alias("formatted"), F.explode(F.array(lengths)).alias("n"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,to:int>>").alias("spans"))
    step = lambda a, x: F.struct(
        (a["at"] + x["h"] + x["b"] + len(END) + 1).alias("at"),
        F.when(x["loss"], F.concat(a["spans"], F.array(F.struct((a["at"] + x["h"]).alias("from"), (a["at"] + x["h"] + x["b"]).alias("to"))))).otherwise(a["spans"]).alias("spans"),
    )
    return df.select(conv, "formatted", F.aggregate("n", zero, step, lambda a: a["spans"]).alias("loss_spans"))


def parsed(text: Column) -> Column:
    """The (role, text) turns of a rendering."""
    turns = F.slice(F.split(text, r"<\|im_start\|>"), F.lit(2), F.greatest(F.size(F.split(text, r"<\|im_start\|>")) - 1, F.lit(0)))

    def turn(x):
        head = F.substring_index(x, "\n", 1)
        body = F.substr(x, F.length(head) + 2, F.length(x) - F.length(head) - 2 - len(END))
        return F.struct(unescape(F.replace(head, F.lit("<|nl|>"), F.lit("\n"))).alias("role"), unescape(body).alias("text"))

    return F.transform(turns, turn)


def digest(df: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What a rendering says when it is read back."""
    df = df.select(conv, "formatted", "loss_spans", F.explode(F.array(parsed(F.col("formatted")))).alias("turns"))
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["from"] + 1, s["to"] - s["from"]))), "")
    df = df.select(conv, F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.explode(F.array(loss)).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return df.select(conv, "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def as_events(conversations: DataFrame, conv: str = "conv_id", chars: int = DELTA_CHARS) -> DataFrame:
    """A log that gives these rows again: a user's text is a draft and an edit, any other one a draft that is dropped and streamed deltas.

    Rows are numbered by turn, role and text (nulls first), so repeated rows stay turns of their own.
    """
    number = F.row_number().over(Window.partitionBy(conv).orderBy("turn", "role", "text"))
    rows = conversations.select(conv, "role", F.coalesce("text", F.lit("")).alias("text"), number.alias("message_id"))
    event = lambda k, kind, text: F.struct(k.alias("k"), F.lit(kind).alias("kind"), text.alias("text"))
    draft = F.substring("text", 1, 40)
    edited = F.array(event(F.lit(0), "start", draft), event(F.lit(1), "edit", F.col("text")))
    cuts = F.sequence(F.lit(0), F.ceil(F.greatest(F.length("text"), F.lit(1)) / chars).cast("int") - 1)
    stream = F.transform(cuts, lambda i: F.struct((i + 3).alias("k"), F.lit("delta").alias("kind"), F.substr("text", i * chars + 1, F.lit(chars)).alias("text")))
    streamed = F.concat(F.array(event(F.lit(0), "start", F.lit("")), event(F.lit(1), "delta", draft), event(F.lit(2), "regenerate", F.lit(""))), stream)
    rows = rows.select(conv, "message_id", "role", F.explode(F.when(F.col("role") == "user", edited).otherwise(streamed)).alias("e"))
    return rows.select(conv, F.struct("message_id", "e.k").alias("seq"), "message_id", "e.kind", "role", "e.text")


def op8_chat_formatting(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = f"{END}{START}assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digest(formatted(messages(as_events(rows.union(more)))))


_ESCAPED = r"regexp_replace(%s, '<(\\*)\|', '<\\\1|', 'g')"

OP8_SQL = f"""
WITH rows AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '{END}{START}assistant ok' FROM range(2) t(k)),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    sum({len(START)} + length(replace({_ESCAPED % "role"}, chr(10), '<|nl|>')) + 1 + length({_ESCAPED % "text"}) + {len(END)} + 1)::BIGINT AS formatted_chars
    FROM rows GROUP BY 1)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c
"""
