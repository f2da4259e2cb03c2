"""Chat formatting by prefix-target expansion (operator 6), in DataFrame functions only.

Every assistant turn becomes an example: all turns before it as context, its own text the only part under the loss
mask. Turns after the last assistant turn, and conversations without one, give a closing example without a target,
so the output holds every turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A turn is OPEN role CLOSE text END. Control strings inside roles and texts are written as the names beside them;
#: the mark of such names is escaped first, so escaping can be undone (fixed values of this template).
OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
ESCAPES = (("&", "&a;"), (END, "&e;"), (OPEN, "&i;"), (CLOSE, "&j;"))
TARGET_ROLE = "assistant"


def escape(c: Column) -> Column:
    for plain, name in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(name))
    return c


def unescape(c: Column) -> Column:
    for plain, name in reversed(ESCAPES):
        c = F.replace(c, F.lit(name), F.lit(plain))
    return c


def format_chat(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, example int, text, loss_start int, loss_chars int): one row an example, examples from 0 by turn.

    The loss mask is the ``loss_chars`` characters of the example's text from ``loss_start`` (from 0): the escaped
    reply; a closing example has none. Turns are ordered by turn, null first, then role and text; repeated rows are
    turns of their own. A null role or text is an empty one, a null conv_id a conversation like any other. Other
    columns are ignored. An example holds its whole context, so a conversation must fit in a row.
    """
    t = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    convs = df.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(t)).alias("turns"))
    convs = convs.select(
        "conv_id",
        F.transform("turns", lambda x: F.concat(F.lit(OPEN), escape(x.role), F.lit(CLOSE))).alias("heads"),
        F.transform("turns", lambda x: escape(x.text)).alias("bodies"),
        F.transform("turns", lambda x: x.role == TARGET_ROLE).alias("reply"),
    )
    n = F.size("reply")
    ends = F.filter(F.sequence(F.lit(1), n), lambda k: (k == n) | F.element_at("reply", k))
    convs = convs.select("conv_id", "heads", "bodies", "reply", F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b, F.lit(END))).alias("marked"), ends.alias("ends"))
    rows = convs.select("conv_id", "heads", "bodies", "reply", "marked", F.posexplode("ends").alias("example", "at"))
    before = F.array_join(F.slice("marked", F.lit(1), F.col("at") - 1), "")
    rows = rows.select("conv_id", "example", before.alias("context"), F.element_at("heads", F.col("at")).alias("head"), F.element_at("bodies", F.col("at")).alias("body"), F.element_at("reply", F.col("at")).alias("is_reply"))
    return rows.select(
        "conv_id",
        "example",
        F.concat("context", "head", "body", F.lit(END)).alias("text"),
        F.when(F.col("is_reply"), F.length("context") + F.length("head")).otherwise(0).alias("loss_start"),
        F.when(F.col("is_reply"), F.length("body")).otherwise(0).alias("loss_chars"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """What the formatted examples hold, read from their texts and loss masks alone, one row a conversation.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. All turns stand in the last example.
    """
    masked = F.substring("text", F.col("loss_start") + 1, F.col("loss_chars"))
    per = examples.select("conv_id", "example", F.length("text").alias("chars"), "text", unescape(masked).alias("loss"))
    per = per.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"), F.max_by("text", "example").alias("last"), F.sum("chars").alias("formatted_chars"))
    marked = F.slice(F.split("last", END), F.lit(1), F.size(F.split("last", END)) - 1)

    def plain(t: Column) -> Column:
        head = F.substring_index(t, CLOSE, 1)
        role = F.substring(head, F.lit(len(OPEN) + 1), F.length(head))
        body = F.substring(t, F.length(head) + len(CLOSE) + 1, F.length(t))
        return F.concat(unescape(role), F.lit("\n"), unescape(body), F.lit("\n"))

    per = per.select("conv_id", marked.alias("turns"), F.array_join(F.transform("losses", lambda x: x.loss), "").alias("loss"), "formatted_chars")
    return per.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", plain), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
