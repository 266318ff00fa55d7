r"""Chat formatting with a grammar round trip, in DataFrame functions only.

Template (one string for each conversation)::

    conversation = "<s>" turn*
    turn         = "[INST] " text " [/INST]"                        user
                 | "<<SYS>> " text " <</SYS>>"                      system
                 | " " text " </s>"                                 assistant
                 | "[ROLE] " role " [TEXT] " text " [/ROLE]"        any other role

The parser is deterministic: one anchored pattern takes the turns from left to right, each up to the first
closing mark. Each turn is rendered plainly and parsed again; where the turn read back is not the turn given,
its content is escaped and the check is made once more, on the conversation as a whole: a mismatch that remains
raises an error instead of passing on a wrong text.

An escape adds one backslash inside anything that looks like a control string with any number of backslashes
(``[INST]`` to ``[\INST]``, ``[\INST]`` to ``[\\INST]``), and reading takes one away, so it is reversible.

Work is per row up to one grouping by conversation, which the result (one text for each conversation) needs.

Results for odd input: a null text or role is empty; turns are in order of (turn, role, text), null turns first,
so ties and repeated rows have a defined order and all stay; a null conv_id is a conversation of its own;
empty tables give empty tables; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import require

# Fixed values of the template.
OPEN = {"user": "[INST] ", "system": "<<SYS>> ", "assistant": " "}
CLOSE = {"user": " [/INST]", "system": " <</SYS>>", "assistant": " </s>"}
OTHER = ("[ROLE] ", " [TEXT] ", " [/ROLE]")
BEGIN = "<s>"
# What is escaped: an opener, any backslashes, and the rest of a control string.
ESCAPE = r"(<<|<|\[)(\\*)(/?(?:SYS>>|INST\]|ROLE\]|TEXT\]|s>))"
UNESCAPE = r"(<<|<|\[)\\(\\*)(/?(?:SYS>>|INST\]|ROLE\]|TEXT\]|s>))"
TURN = (r"(?s)\G(?:\[INST\] .*? \[/INST\]|<<SYS>> .*? <</SYS>>|\[ROLE\] .*? \[TEXT\] .*? \[/ROLE\]"
        r"| .*? </s>)")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPE), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(UNESCAPE), F.lit("$1$2$3"))


def render_turn(role: Column, text: Column) -> Column:
    out = F.concat(F.lit(OTHER[0]), role, F.lit(OTHER[1]), text, F.lit(OTHER[2]))
    for name in OPEN:
        out = F.when(role == name, F.concat(F.lit(OPEN[name]), text, F.lit(CLOSE[name]))).otherwise(out)
    return out


def _between(turn: Column, start: str, end: str) -> Column:
    return turn.substr(F.lit(len(start) + 1), F.length(turn) - len(start) - len(end))


def parse_turn(turn: Column) -> Column:
    """struct(role, text) of one rendered turn."""
    first = r"(?s)^\[ROLE\] (.*?) \[TEXT\] (.*) \[/ROLE\]$"
    out = F.struct(unescape(F.regexp_extract(turn, first, 1)).alias("role"),
                   unescape(F.regexp_extract(turn, first, 2)).alias("text"))
    for name in reversed(["assistant", "user", "system"]):
        out = F.when(turn.startswith(OPEN[name]), F.struct(
            F.lit(name).alias("role"), unescape(_between(turn, OPEN[name], CLOSE[name])).alias("text"))).otherwise(out)
    return out


def parse_conversation(formatted: Column) -> Column:
    """array of struct(role, text); null if the text does not follow the grammar to its end."""
    body = formatted.substr(F.lit(len(BEGIN) + 1), F.length(formatted))
    turns = F.regexp_extract_all(body, F.lit(TURN), F.lit(0))
    whole = formatted.startswith(BEGIN) & (F.array_join(turns, "") == body)
    return F.when(whole, F.transform(turns, parse_turn))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (as read back from ``formatted``), loss_spans: [start, end) code points of
    the assistants' texts in ``formatted``, as escaped there."""
    require(conversations, "conv_id", "turn", "role", "text")
    given = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                                 F.coalesce("text", F.lit("")).alias("text"))
    plain = given.withColumn("plain", render_turn(F.col("role"), F.col("text")))
    read = F.regexp_extract("plain", TURN, 0)
    held = (read == F.col("plain")) & (parse_turn(read) == F.struct("role", "text"))
    safe = plain.withColumn("rendered", F.when(held, F.col("plain")).otherwise(
        render_turn(escape(F.col("role")), escape(F.col("text")))))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = safe.withColumn("at", F.coalesce(F.sum(F.length("rendered")).over(before), F.lit(0)) + len(BEGIN))
    grouped = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(
        F.struct("turn", "role", "text", "at", "rendered"))).alias("given"))
    text = grouped.select("conv_id", "given",
                          F.concat(F.lit(BEGIN), F.array_join("given.rendered", "")).alias("formatted"))
    parsed = text.withColumn("turns", parse_conversation(F.col("formatted")))
    same = F.coalesce(F.col("turns") == F.transform("given", lambda t: F.struct(t["role"], t["text"])), F.lit(False))
    checked = parsed.withColumn("turns", F.when(same, F.col("turns")).otherwise(F.raise_error(
        F.concat(F.lit("chat round trip failed in conversation "), F.coalesce(F.col("conv_id").cast("string"),
                                                                              F.lit("null"))))))
    spans = F.transform(F.filter("given", lambda t: t["role"] == "assistant"), lambda t: F.struct(
        (t["at"] + len(OPEN["assistant"])).alias("start"),
        (t["at"] + F.length(t["rendered"]) - len(CLOSE["assistant"])).alias("end")))
    return checked.select("conv_id", "formatted", "turns", spans.alias("loss_spans"))


def masked_texts(formatted: Column, spans: Column) -> Column:
    """array of the texts under the loss mask, cut from ``formatted`` at ``spans`` and unescaped. In UTF-32 a span
    is cut in one step, however far into the conversation it lies."""
    bom = F.unhex(F.lit("0000FEFF"))  # given, so that a U+FEFF that a text starts with stays
    cut = lambda wide: F.transform(spans, lambda s: unescape(F.decode(F.concat(
        bom, F.substring(wide, 4 * s["start"] + 1, 4 * (s["end"] - s["start"]))), "UTF-32")))
    return F.transform(F.array(F.encode(formatted, "UTF-32")), cut)[0]  # encoded once, not once a span


def digests(formatted: DataFrame) -> DataFrame:
    """The digest columns of ``format_conversations``: of the turns read back from its output, and of the text
    under its loss mask."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    masked = masked_texts(F.col("formatted"), F.col("loss_spans"))
    return formatted.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"), F.array_join(masked, "").alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
