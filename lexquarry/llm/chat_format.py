"""Chat formatting from an event log, in DataFrame functions throughout.

A log holds what happened to each message: ``start`` (its role), ``delta`` (text
streamed in), ``edit`` (the whole text anew) and ``regenerate`` (what was streamed
so far is void). Events meet by conversation and message, so a long conversation
spreads over tasks; sorted by sequence, the last event that resets a message and
the deltas after it give its final text. Each message is then rendered by itself,
and a conversation's turns are put together in order, with its loss mask.

Every ``<`` and ``[`` inside a role or text gets a mark after it, so that no
control string occurs in either, and taking each mark off gives the text back.

Null texts and roles are empty; null turns come first; rows of one turn are taken
by role and then by text; repeated rows are messages of their own; a null id is a
conversation of its own. Other columns are passed over, and an empty table gives
an empty result. Texts are never cut; the texts of one conversation have to fit in
one value (2 GB), since its digest is one value of a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template: a turn's role stands between OPEN and HEAD, its text between HEAD and CLOSE.
OPEN, HEAD, CLOSE = "[INST]", "[/INST]", "</s>"
MARK = "\\"

#: Code points of a streamed delta.
DELTA = 512
#: Events after which nothing before counts.
RESETS = ("start", "edit", "regenerate")


def escape(c: Column) -> Column:
    for sign in "<[":
        c = F.replace(c, F.lit(sign), F.lit(sign + MARK))
    return c


def unescape(c: Column) -> Column:
    for sign in "<[":
        c = F.replace(c, F.lit(sign + MARK), F.lit(sign))
    return c


# Logs ------------------------------------------------------------------------


def pieces_of(text: Column) -> Column:
    """A text's pieces of DELTA code points, in one scan."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{DELTA}}}"), 0)


def event_log(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, msg, seq, kind, said)``: a log that ends in ``rows(conv_id, turn, role, text)``.

    By its checksum, a message is streamed at once, streamed in part and then
    regenerated, or streamed and then edited.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = rows.select("conv_id", F.col("turn").try_cast("long").alias("turn"), F.monotonically_increasing_id().alias("msg"), role.alias("role"), text.alias("text"))
    own = own.withColumn("way", F.crc32(F.concat_ws(":", "conv_id", "turn").cast("binary")) % 3).withColumn("parts", pieces_of(F.col("text")))

    def event(kind: str, said: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), said.alias("said"))

    def deltas(parts: Column) -> Column:
        return F.transform(parts, lambda p: event("delta", p))

    draft = deltas(F.slice(F.reverse("parts"), 1, F.greatest(F.size("parts") / 2, F.lit(1)).cast("int")))
    begun, none = F.array(event("start", F.col("role"))), F.lit(None).cast("string")
    log = (
        F.when(F.col("way") == 0, F.concat(begun, deltas(F.col("parts"))))
        .when(F.col("way") == 1, F.concat(begun, draft, F.array(event("regenerate", none)), deltas(F.col("parts"))))
        .otherwise(F.concat(begun, draft, F.array(event("edit", F.col("text")))))
    )
    return own.select("conv_id", "turn", "msg", F.posexplode(log).alias("seq", "e")).select("conv_id", "turn", "msg", "seq", "e.kind", "e.said")


def messages(log: DataFrame) -> DataFrame:
    """``(conv_id, turn, msg, role, text)``: each message as its log leaves it; a message without a start has an empty role."""
    event = F.struct("seq", "kind", "said")
    met = log.groupBy("conv_id", "msg").agg(F.max("turn").alias("turn"), F.array_sort(F.collect_list(event)).alias("log"))  # a message's own events
    reset = F.array_max(F.transform(F.filter("log", lambda e: e["kind"].isin(*RESETS)), lambda e: e["seq"]))
    met = met.withColumn("reset", F.coalesce(reset, F.lit(-1)))
    live = F.filter("log", lambda e: (e["seq"] >= F.col("reset")) & e["kind"].isin("delta", "edit"))
    role = F.element_at(F.filter("log", lambda e: e["kind"] == "start"), -1)
    role = F.when(F.exists("log", lambda e: e["kind"] == "start"), role["said"])
    return met.select("conv_id", "turn", "msg", F.coalesce(role, F.lit("")).alias("role"), F.array_join(F.transform(live, lambda e: e["said"]), "").alias("text"))


# Rendering -------------------------------------------------------------------


def rendered(said: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss)``: each conversation's turns in order, and its loss mask.

    loss: of each assistant turn ``(nth, start, length)``, code points of the
    turn's own part of ``formatted`` (up to and with its CLOSE).
    """
    role, text = escape(F.col("role")), escape(F.col("text"))
    whole = F.concat(F.lit(OPEN), role, F.lit(HEAD), text, F.lit(CLOSE))
    turn = said.select("conv_id", "turn", "role", "text", "msg", whole.alias("part"), (F.length(role) + len(OPEN) + len(HEAD)).alias("start"), F.length(text).alias("length"))
    turn = turn.select("conv_id", F.struct("turn", "role", F.col("text").alias("said"), "msg", "part", (F.col("role") == "assistant").alias("learnt"), "start", "length").alias("t"))
    met = turn.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    learnt = F.filter(F.transform("ts", lambda t, i: F.struct(i.alias("nth"), (t["start"] + 1).alias("start"), t["length"].alias("length"), t["learnt"].alias("learnt"))), lambda t: t["learnt"])
    spans = F.transform(learnt, lambda t: F.struct(t["nth"].alias("nth"), t["start"].alias("start"), t["length"].alias("length")))
    return met.select("conv_id", F.array_join(F.transform("ts", lambda t: t["part"]), "").alias("formatted"), spans.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``(conv_id, turns array<struct<role, text>>, learnt array<string>, formatted_chars)`` from what ``rendered`` returns."""
    parts = F.slice(F.split("formatted", CLOSE), 1, F.size(F.split("formatted", CLOSE)) - 1)
    cut = formatted.select("conv_id", parts.alias("parts"), "loss", F.length("formatted").cast("long").alias("formatted_chars"))

    def turn(part: Column) -> Column:
        at = F.instr(part, HEAD)
        return F.struct(unescape(F.substring(part, len(OPEN) + 1, at - len(OPEN) - 1)).alias("role"), unescape(F.substring(part, at + len(HEAD), F.length(part))).alias("text"))

    learnt = F.transform("loss", lambda s: unescape(F.substring(F.get(F.col("parts"), s["nth"]), s["start"], s["length"])))
    return cut.select("conv_id", F.transform("parts", turn).alias("turns"), learnt.alias("learnt"), "formatted_chars")


def format_digest(rows: DataFrame) -> DataFrame:
    """Digests of every conversation, read back from its formatted text."""
    read = read_back(rendered(messages(event_log(rows))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), F.array_join("learnt", "").alias("learnt"), "formatted_chars")
    return read.select(
        "conv_id", "n_turns", F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )
