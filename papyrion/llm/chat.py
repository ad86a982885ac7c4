"""Chat formatting by a grammar round trip, in DataFrame functions only.

The rendered form of a conversation is, turn by turn, ``<|im_start|>role\\ntext<|im_end|>\\n``. The grammar is
deterministic: text between a start mark and the next end mark is a turn. In it, ``<``, n backslashes and ``|`` stands
for the same with one backslash less, so no text can hold a mark. A turn is rendered as it is, reparsed and compared;
where that differs, it's rendered with one backslash more in each such string, and compared again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: A line end within a role; raw roles can't hold it, as escaped ones have a backslash before the bar.
ROLE_LINE_END = "<|nl|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(f"{END}\n"))


def parse(formatted: Column) -> Column:
    """Turns of a formatted conversation as array<struct<role, text>>, unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p, i: i > 0)
    body = lambda p: F.regexp_replace(p, r"(?s)<\|im_end\|>.*", "")

    def turn(piece: Column) -> Column:
        whole = body(piece)
        line_end = F.instr(whole, "\n")
        role = F.regexp_replace(F.substring(whole, F.lit(1), line_end - 1), r"<\|nl\|>", "\n")
        return F.struct(unescape(role).alias("role"), unescape(F.substring(whole, line_end + 1, F.length(whole))).alias("text"))

    return F.transform(pieces, turn)


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, turns, escaped): one row for each conversation, its turns read back from the formatted text.

    Rows go by turn (null first), equal turns by role and text; repeated rows are turns of their own. Null role or text
    counts as empty, a null conversation id as one conversation. An empty table gives no rows; other columns are not
    read. Long texts are taken whole. A conversation is one output row, so its turns meet in one task; a conversation
    whose turns don't come back identical stops the job.
    """
    held = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    once = parse(render(F.col("role"), F.col("text")))
    fits = (F.size(once) == 1) & (once[0]["role"] == F.col("role")) & (once[0]["text"] == F.col("text"))
    safe = F.regexp_replace(escape(F.col("role")), "\n", ROLE_LINE_END)
    shown = held.withColumn("fits", F.coalesce(fits, F.lit(False)))
    shown = shown.withColumn("rendered", F.when(F.col("fits"), render(F.col("role"), F.col("text"))).otherwise(render(safe, escape(F.col("text")))))
    gathered = shown.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "rendered", "fits"))).alias("rows"))
    joined = gathered.select("conv_id", "rows", F.array_join(F.transform("rows", lambda r: r["rendered"]), "").alias("formatted"))
    back = joined.withColumn("turns", parse(F.col("formatted")))
    source = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")))
    checked = F.when(F.col("turns") == source, F.col("turns")).otherwise(F.raise_error(F.lit("a conversation doesn't come back from its formatted text")).cast("array<struct<role:string,text:string>>"))
    return back.select("conv_id", "formatted", checked.alias("turns"), F.size(F.filter("rows", lambda r: ~r["fits"])).cast("long").alias("escaped"))


def loss_text(turns: Column, role: str = "assistant") -> Column:
    """All text under the loss mask: that of the assistant's turns, in order, nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: t["text"]), "")


def digests(formatted: DataFrame) -> DataFrame:
    """The contract's columns, from the formatted text read back."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = loss_text(F.col("turns"))
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
