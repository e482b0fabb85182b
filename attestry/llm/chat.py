"""Chat formatting from event logs, in built-in Spark functions throughout.

A conversation is a log of events: ``conv_id``, ``seq`` (order in the conversation), ``turn``, ``message``
(number within the turn), ``kind``, ``role`` and ``text``. Kinds: ``open`` begins a turn's message, ``delta`` appends streamed text, ``edit``
replaces what the turn says so far, ``regenerate`` empties it for a new answer, whose deltas follow. Events are
folded by turn, so a long conversation spreads over tasks; turns are then sorted and rendered.

The template marks a turn as ``<|role|>\\n text <|end|>\\n``. Inside roles and texts ``&`` and ``<`` are written
``&amp;`` and ``&lt;`` (in roles ``|`` is ``&bar;`` too), so that no text can hold a mark, and reading undoes it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "<|end|>\n"


def escape(c: Column) -> Column:
    """No ``<`` is left, and ``&`` only as the start of an escape."""
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def events_of(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The event log that whole turns stand for: each is opened and streamed in two deltas.

    Rows with the same conversation and turn are messages of their own, numbered by role and text, so that
    repeated rows and ties are all kept.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    half = F.floor(F.length(t) / 2).cast("int")
    r = F.coalesce(F.col(role).cast("string"), F.lit(""))
    number = F.row_number().over(Window.partitionBy(conv, turn).orderBy(r, t))
    parts = F.array(
        F.struct(F.lit(0).alias("n"), F.lit("open").alias("kind"), F.lit("").alias("text")),
        F.struct(F.lit(1).alias("n"), F.lit("delta").alias("kind"), F.substring(t, F.lit(1), half).alias("text")),
        F.struct(F.lit(2).alias("n"), F.lit("delta").alias("kind"), F.substring(t, half + 1, F.length(t)).alias("text")),
    )
    base = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), number.alias("message"), r.alias("role"), parts.alias("e"))
    base = base.select("conv_id", "turn", "message", "role", F.explode("e").alias("e"))
    return base.select("conv_id", (F.coalesce(F.col("turn"), F.lit(-1)) * 3 + F.col("e.n")).alias("seq"), "turn", "message", "e.kind", "role", "e.text")


def messages(events: DataFrame) -> DataFrame:
    """Fold the log: ``conv_id``, ``turn``, ``message``, ``role``, ``text`` as they finally stand.

    Events of a message act by ``seq``; equal ones by kind (open, edit, regenerate, delta), then text. The last
    ``edit`` or ``regenerate`` decides where the final text begins. A null turn counts as one turn of its own
    and sorts first, a null text is empty, an unknown kind is read as ``delta``, an event twice in the log acts
    twice unless it is an ``open``. A message's role is that of its last event with one. What is gathered for a
    message is its own text.
    """
    order = F.when(F.col("kind") == "open", 0).when(F.col("kind") == "edit", 1).when(F.col("kind") == "regenerate", 2).otherwise(3)
    key = ["conv_id", "turn", "message"]
    e = events.select(*key, "role", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("kind", F.lit("delta")).alias("kind"), F.struct(F.col("seq"), order.alias("k")).alias("at"))
    # One aggregation: the parts in order, and from which of them on the text counts.
    parts = F.sort_array(F.collect_list(F.struct("at", F.when(F.col("kind") == "regenerate", "").otherwise(F.col("text")).alias("text"))))
    g = e.groupBy(*key).agg(parts.alias("p"), F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("at"))).alias("since"), F.max(F.when(F.col("role").isNotNull(), F.struct("at", "role")))["role"].alias("role"))
    live = F.filter("p", lambda x: F.col("since").isNull() | (x["at"] >= F.col("since")))
    return g.select(*key, F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform(live, lambda x: x["text"]), "").alias("text"))


def render(msgs: DataFrame) -> DataFrame:
    """``conv_id``, ``formatted``, and ``loss``: the spans (start, length in code points) of assistant texts.

    Turns by ``turn``, then ``message``. One conversation is one value of the result, so its own turns are
    what a task holds for it; other conversations are elsewhere.
    """
    head = F.concat(F.lit("<|"), F.replace(escape(F.col("role")), F.lit("|"), F.lit("&bar;")), F.lit("|>\n"))
    body = escape(F.col("text"))
    t = msgs.select("conv_id", F.struct("turn", "message", "role", "text", head.alias("head"), body.alias("body")).alias("m"))
    g = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    # The places of the texts: a running sum of what stands before.
    at = F.expr(
        f"aggregate(m, struct(0L as at, cast(array() as array<struct<start: bigint, length: bigint>>) as loss), (a, x) -> struct("
        f"a.at + length(x.head) + length(x.body) + {len(END)} as at,"
        " if(x.role = 'assistant', array_append(a.loss, struct(a.at + length(x.head) as start, cast(length(x.body) as bigint) as length)), a.loss) as loss), a -> a.loss)"
    )
    whole = F.expr(f"array_join(transform(m, x -> concat(x.head, x.body, '{END[:-1]}\\n')), '')")
    return g.select("conv_id", whole.alias("formatted"), at.alias("loss"))


def parse(formatted: Column) -> Column:
    """The (role, text) structs of a rendered conversation, in order."""
    roles = F.regexp_extract_all(formatted, F.lit(r"<\|([^<|]*+)\|>\n[^<]*+<\|end\|>\n"), F.lit(1))
    texts = F.regexp_extract_all(formatted, F.lit(r"<\|[^<|]*+\|>\n([^<]*+)<\|end\|>\n"), F.lit(1))
    return F.zip_with(roles, texts, lambda r, t: F.struct(unescape(F.replace(r, F.lit("&bar;"), F.lit("|"))).alias("role"), unescape(t).alias("text")))


def digest(rendered: DataFrame) -> DataFrame:
    """What the output itself says: turns, their hash, and the text under the loss mask."""
    r = rendered.withColumn("t", parse(F.col("formatted")))
    r = r.withColumn("masked", F.expr("transform(loss, s -> substring(formatted, cast(s.start as int) + 1, cast(s.length as int)))"))
    r = r.withColumn("lost", F.array_join(F.transform("masked", unescape), ""))
    turns = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return r.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("lost").cast("long").alias("loss_chars"), F.sha2("lost", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
