"""Chat formatting by event-sourced reconstruction.

Logs are partitioned by conversation and sorted by sequence number; streamed
deltas, edits and regenerations are folded into final messages, which are then
rendered with a template whose control strings cannot occur inside texts.
DataFrame functions only.

Events have ``conv_id, seq, event, turn, role, text``; ``event`` is one of
  message     starts (or restarts) the message of a turn with ``text``
  delta       appends ``text`` to the message of its turn
  edit        replaces the text of the message of its turn
  regenerate  drops what the turn has so far; deltas after it fill it anew
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Control strings of common chat templates; "<|" begins ours.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    """Double every backslash, then put one after the first character of each
    control string.  ``unescape`` takes it back exactly."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages, one row per conversation: ``conv_id, messages`` with
    ``messages`` an array of (turn, role, text) by turn.

    Null text counts as empty, a null event as ``message``; a turn's role is
    the last one its events name, else empty.  A turn without any event but
    deltas is their sum.  Events with the same ``seq`` are ordered by event
    name and text.  A null ``conv_id`` is a conversation of its own, a null
    turn comes first.  An empty log gives no rows.  Other columns are not
    read.  One exchange, by ``conv_id``: a conversation is one row of the
    result, so its rows meet in any case, and as folded messages only."""
    e = (events.select("conv_id", "turn", F.coalesce("seq", F.lit(0)).alias("seq"),
                       F.coalesce("event", F.lit("message")).alias("event"), "role",
                       F.coalesce("text", F.lit("")).alias("text"))
         .repartition("conv_id"))
    turns = e.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("seq", "event", "text", "role"))).alias("ev"))
    last = F.array_max(F.transform("ev", lambda x, i: F.when(x["event"] == "delta", F.lit(1)).otherwise(i + 1)))
    roles = F.filter(F.transform("ev", lambda x: x["role"]), lambda r: r.isNotNull())
    folded = turns.select(
        "conv_id", "turn",
        F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(F.transform(F.slice("ev", last, F.size("ev")),
                                 lambda x: F.when(x["event"] == "regenerate", "").otherwise(x["text"])), "").alias("text"))
    return folded.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))


def render(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``conv_id, segments, formatted``: the segments are the pieces of
    ``formatted`` in order, each with its loss flag; the loss is on the texts
    of ``loss_role`` alone, not on marks or other turns."""
    segments = F.flatten(F.transform("messages", lambda m: F.array(
        F.struct(F.concat(F.lit(TURN), escape(m["role"]), F.lit(TEXT)).alias("piece"), F.lit(False).alias("loss")),
        F.struct(escape(m["text"]).alias("piece"), (m["role"] == loss_role).alias("loss")),
        F.struct(F.lit(END).alias("piece"), F.lit(False).alias("loss")))))
    return (conversations.select("conv_id", segments.alias("segments"))
            .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["piece"]), "")))


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests read from the rendered strings: the turns from ``formatted``,
    the loss text from the segments under the mask."""
    pieces = F.filter(F.split("formatted", r"<\|turn\|>"), lambda p: p != "")
    head = lambda p: F.substring_index(p, TEXT, 1)
    turns = F.transform(pieces, lambda p: F.concat(
        unescape(head(p)), F.lit("\n"),
        unescape(p.substr(F.length(head(p)) + len(TEXT) + 1, F.length(p) - F.length(head(p)) - len(TEXT) - len(END))),
        F.lit("\n")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["piece"])), "")
    return (rendered.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), F.length("formatted").alias("n"))
            .select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                    F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
                    F.length("loss_text").cast("long").alias("loss_chars"),
                    F.sha2("loss_text", 256).alias("loss_sha256"),
                    F.col("n").cast("long").alias("formatted_chars")))


def events_of(conversations: DataFrame) -> DataFrame:
    """A table of whole messages as an event log.  Rows are numbered by turn
    (ties by role and text), so rows repeated with one turn all stay."""
    from pyspark.sql import Window
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select("conv_id", "role", "text", F.row_number().over(w).cast("long").alias("seq")).select(
        "conv_id", "seq", F.lit("message").alias("event"), F.col("seq").alias("turn"), "role", "text")


def streamed_log(conversations: DataFrame) -> DataFrame:
    """A table of whole messages as the log of a chat service, by turn number:
    a message arrives in three deltas, or as a draft that is edited, or as a
    first attempt that is regenerated and streamed anew.  The final texts are
    those of the table."""
    rows = events_of(conversations).withColumn("text", F.coalesce("text", F.lit("")))
    n = F.length("text")
    one, two = F.floor(n / 3).cast("int"), F.floor(2 * n / 3).cast("int")
    cut = lambda a, b: F.col("text").substr(a + 1, b - a)
    thirds = [cut(F.lit(0), one), cut(one, two), cut(two, n)]
    event = lambda k, name, text: F.struct(
        (F.col("turn") * 8 + k).alias("seq"), F.lit(name).alias("event"), (F.col("role") if k == 0 else F.lit(None).cast("string")).alias("role"), text.alias("text"))
    deltas = lambda k: [event(k + i, "delta", t) for i, t in enumerate(thirds)]
    kinds = [F.array(*deltas(0)),
             F.array(event(0, "message", F.concat(F.lit("draft of "), F.col("text"))), event(1, "delta", F.lit(" ...")), event(2, "edit", F.col("text"))),
             F.array(event(0, "delta", thirds[1]), event(1, "delta", F.lit("no, ")), event(2, "regenerate", F.lit("dropped")), *deltas(3))]
    pick = F.when(F.col("turn") % 3 == 0, kinds[0]).when(F.col("turn") % 3 == 1, kinds[1]).otherwise(kinds[2])
    return rows.select("conv_id", "turn", F.inline(pick)).select("conv_id", "seq", "event", "turn", "role", "text")
