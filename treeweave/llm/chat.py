"""Chat formatting by prefix-target expansion (operator 9).

DataFrame functions only; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeweave.runtime import col_of

#: Turn marks of the template. A turn is BEGIN role newline text END.
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings of common chat templates without their first character, and that character.
CONTROL = r"([<\[])(\\*)(\|im_start\||\|im_end\||\|endoftext\||/?s>|/?INST\]|</?SYS>>)"
ESCAPED = r"([<\[])\\(\\*)(\|im_start\||\|im_end\||\|endoftext\||/?s>|/?INST\]|</?SYS>>)"
TARGET_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Put a backslash after the first character of each control string, and one more where backslashes stand there already: reversible, and no control string is left."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def escape_role(role: Column) -> Column:
    """Roles stay on one line: backslash and newline become \\\\ and \\n; control strings are escaped as in texts."""
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # the pieces between doubled backslashes hold only \n marks
    parts = F.transform(F.split(role, r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return unescape(F.array_join(parts, "\\"))


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One training example for each assistant turn: all turns before it as context, that reply as target.

    Returns ``conv_id``, ``example`` (from 0), ``formatted``, ``loss_start`` and
    ``loss_length`` (code points of ``formatted`` under the loss mask: the reply
    without its marks) and ``last`` (the conversation's last example). Turns
    after the last assistant turn, if any, come in one more example, without
    loss, that holds the whole conversation; so does a conversation without an
    assistant turn.

    Turns sort by ``turn``, null first; ties sort by role and text, and equal
    rows all stay. A null text is empty, a null role is an empty role; rows
    with a null conv_id are one conversation. Other columns are ignored.

    A conversation is one group and must fit in a task as one text, as each of
    its examples must: a prefix-target expansion repeats every prefix, so the
    output grows with the square of the turns. Texts are formatted whole, an
    empty table gives no rows.
    """
    turn = F.struct(
        col_of(turn_col).cast("long").alias("turn"),
        F.coalesce(col_of(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(col_of(text_col).cast("string"), F.lit("")).alias("text"),
    )
    chats = rows.groupBy(col_of(conv_col).cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    marked = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(BEGIN), escape_role(t["role"]), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
        ),
    )
    # The whole conversation is one text; END stands once a turn, as texts have it escaped, so a prefix of turns is what lies before the END of its last.
    whole = F.array_join(F.transform(marked, lambda t: F.concat(t["head"], t["body"])), END)
    places = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == TARGET_ROLE, i + 1)), lambda i: i.isNotNull())
    numbered = chats.select("conv_id", whole.alias("whole"), F.size("turns").alias("n"), places.alias("places"))
    with_rest = F.when(F.coalesce(F.try_element_at("places", F.lit(-1)), F.lit(0)) == F.col("n"), F.col("places")).otherwise(F.concat("places", F.array("n")))
    targets = F.size("places")
    each = numbered.select("conv_id", "whole", "n", targets.alias("targets"), F.posexplode(with_rest).alias("example", "upto"))
    upto = each.select("conv_id", "example", (F.col("upto") == F.col("n")).alias("last"), (F.col("example") < F.col("targets")).alias("target"), F.call_function("substring_index", "whole", F.lit(END), "upto").alias("turns"))
    own = F.substring_index("turns", BEGIN, -1)  # the last turn: role, newline, text
    body = F.char_length(own) - F.char_length(F.substring_index(own, "\n", 1)) - 1
    parts = upto.select("conv_id", "example", "last", "target", "turns", body.alias("body"))
    return parts.select(
        "conv_id",
        "example",
        F.concat("turns", F.lit(END)).alias("formatted"),
        F.when(F.col("target"), F.char_length("turns") - F.col("body")).alias("loss_start"),
        F.when(F.col("target"), F.col("body")).otherwise(F.lit(0)).alias("loss_length"),
        "last",
    )


def parse_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted example, in order."""
    turns = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != "")
    return F.transform(
        turns,
        lambda x: F.struct(
            unescape_role(F.substring_index(x, "\n", 1)).alias("role"),
            unescape(_body(x)).alias("text"),
        ),
    )


def _body(x: Column) -> Column:
    """A marked turn without its role line and END."""
    head = F.char_length(F.substring_index(x, "\n", 1)) + F.lit(1)
    return F.substring(x, head + F.lit(1), F.char_length(x) - head - F.lit(len(END)))


def read_back(examples: DataFrame) -> DataFrame:
    """What formatted examples hold, a row for each conversation.

    ``n_turns`` and ``turns_sha256`` (role, newline, text, newline for each turn)
    from the last example; ``loss_chars`` and ``loss_sha256`` of the texts under
    all loss masks, unescaped, in order, with nothing between; and
    ``formatted_chars``, the code points of all examples.
    """
    loss = F.when(F.col("loss_length") > 0, unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_length")))).otherwise(F.lit(""))
    seen = examples.select(
        "conv_id",
        F.struct("example", loss.alias("text")).alias("loss"),
        F.char_length("formatted").cast("long").alias("chars"),
        F.when(F.col("last"), parse_turns(F.col("formatted"))).alias("turns"),
    )
    by = seen.groupBy("conv_id").agg(
        F.first("turns", ignorenulls=True).alias("turns"), F.sort_array(F.collect_list("loss")).alias("loss"), F.sum("chars").alias("formatted_chars")
    )
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss_text = F.array_join(F.col("loss.text"), "")
    return by.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss_text).cast("long").alias("loss_chars"),
        F.sha2(loss_text.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
