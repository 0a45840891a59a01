r"""Chat formatting: logs of chat events are folded into final messages, which are rendered as marked turns with a loss mask.

An event has conv_id, message (which message of the conversation it is about), seq (its place in the conversation's log;
anything that sorts), kind, role and text:

- message: the whole text; delta: a streamed piece behind what is there; edit: a new text; regenerate: the text so far is
  void, what streams in from now on replaces it; delete: the message goes, unless more follows.

A message's events are dealt by conversation and message and folded in the order of seq, so a conversation with a third
of all events is spread over tasks, and a task holds one message's events at a time. Messages stand where their first
event stands.

A turn is `<|im_start|>role\ntext<|im_end|>\n`. Control strings (CONTROLS) in texts and roles get one more backslash
behind their first character, so bare ones are always marks, and taking one backslash away reads the text back. The loss
mask of a turn is the place of an assistant's text in it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What marks turns here, and what other chat templates use. Fixed values.
START, END = "<|im_start|>", "<|im_end|>"
CONTROLS = [START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
#: Kinds of events; of those in ANEW, what came before is void.
KINDS = ["message", "delta", "edit", "regenerate", "delete"]
ANEW = ["message", "edit", "regenerate", "delete"]


def _behind(first: str) -> str:
    return "(?:" + "|".join(re.sub(r"([^\w\s])", r"\\\1", c[1:]) for c in CONTROLS if c[0] == first) + ")"


#: Where a backslash is put, and which one is taken away: behind the first character of a control string, whose other ones may have backslashes before them.
PUT = rf"(?<=<)(?=\\*{_behind('<')})|(?<=\[)(?=\\*{_behind('[')})"
TAKE = re.compile(rf"(?<=<)\\(?=\\*{_behind('<')})|(?<=\[)\\(?=\\*{_behind('[')})")
TURN = re.compile(f"{re.escape(START)}([^\n]*)\n(.*?){re.escape(END)}\n", re.DOTALL)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, PUT, r"\\")


def escaped_role(role: Column) -> Column:
    """Escaped, and on one line."""
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def plain(text: str) -> str:
    """What escaped() was given."""
    return TAKE.sub("", text)


def plain_role(role: str) -> str:
    """What escaped_role() was given."""
    return plain(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def messages(events: DataFrame) -> DataFrame:
    """(conv_id, position, message, role, text) of the messages that a log (conv_id, message, seq, kind, role, text) ends in.

    position is the seq of a message's first event. The role is the first that an event gives; none is the empty role.
    Null texts are empty; null conversations, messages and places in the log are values of their own, the places first.
    Events of no known kind are passed over; events at one place are taken by kind, role and text. An empty log gives no
    rows, further columns are ignored.
    """
    e = F.struct("seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = events.where(F.col("kind").isin(KINDS)).groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(e)).alias("e"))
    rows = rows.withColumn("at", F.array_max(F.transform("e", lambda x, i: F.when(x["kind"].isin(ANEW), i + 1).otherwise(1))))  # where what counts begins
    rows = rows.withColumn("live", F.slice("e", F.col("at"), F.size("e")))
    text = F.array_join(F.transform(F.filter("live", lambda x: ~x["kind"].isin("regenerate", "delete")), lambda x: x["text"]), "")
    role = F.coalesce(F.get(F.filter(F.transform("e", lambda x: x["role"]), lambda r: r.isNotNull()), F.lit(0)), F.lit(""))
    gone = (F.size("live") == 1) & (F.col("live")[0]["kind"] == "delete")
    return rows.where(~gone).select("conv_id", F.col("e")[0]["seq"].alias("position"), "message", role.alias("role"), text.alias("text"))


def render(final: DataFrame) -> DataFrame:
    """(conv_id, position, message, turn, loss_start, loss_end) of messages(): a row for each turn, to be read in the order of position, then message.

    A conversation's format is its turns one behind the other. The loss mask is in code points of the turn, end exclusive;
    where nothing is learnt from a turn, both are 0.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = final.select("conv_id", "position", "message", F.concat(F.lit(START), escaped_role(role), F.lit("\n")).alias("head"), escaped(text).alias("body"), (role == "assistant").alias("learn"))
    first = F.when(F.col("learn"), F.length("head")).otherwise(0)
    last = F.when(F.col("learn"), F.length("head") + F.length("body")).otherwise(0)
    return rows.select("conv_id", "position", "message", F.concat("head", "body", F.lit(END + "\n")).alias("turn"), first.alias("loss_start"), last.alias("loss_end"))


def read(turns: str) -> list[tuple[str, str]]:
    """(role, text) of a format, read back."""
    out, at = [], 0
    for m in TURN.finditer(turns):
        if m.start() != at:
            break
        out.append((plain_role(m[1]), plain(m[2])))
        at = m.end()
    if at != len(turns):
        raise ValueError(f"no turn at {at}")
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns sorted by conversation and place -> a row for each conversation; a turn is held at a time."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    none = object()
    now, said, learnt, n, loss, size = none, None, None, 0, 0, 0
    rows: list[tuple] = []
    schema = None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    for b in batches:
        schema = pa.schema(list(zip(names, [b.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True)))
        for conv, turn, first, last in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if now is none or conv != now:
                if now is not none:
                    rows.append((now, n, said.hexdigest(), loss, learnt.hexdigest(), size))
                now, said, learnt, n, loss, size = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for role, text in read(turn):
                said.update(f"{role}\n{text}\n".encode())
                n += 1
            under = plain(turn[first:last])
            learnt.update(under.encode())
            loss += len(under)
            size += len(turn)
        if rows:
            yield out()
            rows = []
    if now is not none:
        rows.append((now, n, said.hexdigest(), loss, learnt.hexdigest(), size))
        yield out()


def digest(turns: DataFrame) -> DataFrame:
    """render()'s turns, read back: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation.

    A digest goes through a conversation's bytes in order, so they pass one task, a turn at a time.
    """
    kind = dict(turns.dtypes)["conv_id"]
    rows = turns.repartition("conv_id").sortWithinPartitions("conv_id", "position", "message").select("conv_id", "turn", "loss_start", "loss_end")
    return rows.mapInArrow(_digests, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def log_of(rows: DataFrame) -> DataFrame:
    """The log of a table of finished turns (conv_id, turn, role, text): an assistant's text streams in line by line, others come whole.

    Every row is a message. Rows of one turn go by their hash; a null text is an empty one.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "(?<=\n)", -1)
    streamed = F.coalesce(F.col("role") == "assistant", F.lit(False))
    own = F.struct(F.xxhash64("role", "text").alias("mark"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select("conv_id", "turn", "role", own.alias("message"), streamed.alias("streamed"), F.when(streamed, lines).otherwise(F.array(text)).alias("pieces"))
    rows = rows.select("conv_id", "turn", "role", "message", "streamed", F.posexplode("pieces").alias("piece", "text"))
    return rows.select("conv_id", "message", F.struct("turn", "piece").alias("seq"), F.when(F.col("streamed"), "delta").otherwise("message").alias("kind"), "role", "text")
