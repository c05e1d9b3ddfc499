r"""Chat formatting with typed content parts.

A visitor turns each part of a message into text: text parts are escaped, image, audio and document parts become
ordered placeholders, and their references and expanded token counts are recorded beside the text. Turns are written as

    ### <Role>: <body> </turn>\n

and inside bodies and roles ``\``, ``#`` and ``<`` are preceded by ``\``, so no text can hold a control string and reading
back restores every character. The loss mask covers the bodies of the assistant's turns, as one (skip, take) run a turn.

Cases: null text is empty; a null role is empty; turns with equal numbers are ordered by role, then text; repeated rows are turns
of their own; unknown part types raise no error but become ``<|type|>`` without tokens; very long texts are escaped whole; an empty
table gives no rows; other columns of the input, whatever their names, are not read. A conversation is one row, so its turns meet in
one task: that is the size of its own result, and nothing larger is gathered. Rows without a conversation id are one conversation;
where a table holds more of those than one row can, give them ids first. Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = " </turn>\n"
NAMED = {"user": "User", "assistant": "Assistant", "system": "System", "tool": "Tool"}
#: Tokens that a placeholder expands to: (fixed, for each unit: tile, second, page).
EXPANSION = {"image": (85, 170), "audio": (0, 25), "document": (0, 512)}
PARTS = "array<struct<type:string,text:string,ref:string,units:int>>"


def escape(col: Column) -> Column:
    return F.regexp_replace(col, r"([\\#<])", r"\\$1")


def unescape(col: Column) -> Column:
    return F.regexp_replace(col, r"(?s)\\(.)", "$1")


def _write_role(role: Column) -> Column:
    out = F.concat(F.lit("="), F.regexp_replace(escape(role), ":", r"\\:"))
    for raw, shown in NAMED.items():
        out = F.when(role == raw, shown).otherwise(out)
    return out


def _read_role(shown: Column) -> Column:
    out = unescape(F.substr(shown, F.lit(2)))
    for raw, name in NAMED.items():
        out = F.when(shown == name, raw).otherwise(out)
    return out


def text_part(text: Column) -> Column:
    """A message of one text part."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), none.cast("string").alias("ref"), none.cast("int").alias("units"))).cast(PARTS)


def visit(part: Column) -> Column:
    is_text = part["type"] == "text"
    return F.when(is_text, escape(F.coalesce(part["text"], F.lit("")))).otherwise(
        F.concat(F.lit("<|"), escape(F.coalesce(part["type"], F.lit("unknown"))), F.lit("|>"))
    )


def expanded(part: Column) -> Column:
    units = F.coalesce(part["units"], F.lit(1)).cast("long")
    out = F.lit(0).cast("long")
    for kind, (fixed, each) in EXPANSION.items():
        out = F.when(part["type"] == kind, F.lit(fixed) + F.lit(each) * units).otherwise(out)
    return out


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row a conversation: conv, n_turns, formatted, mask, attachments (type, ref, tokens; in order), attachment_tokens."""
    parts_col = F.coalesce(F.col(parts).cast(PARTS), F.array().cast(PARTS))
    who = F.coalesce(F.col(role), F.lit(""))
    head = F.concat(F.lit("### "), _write_role(who), F.lit(": "))
    body = F.array_join(F.transform(parts_col, visit), "")
    extras = F.transform(
        F.filter(parts_col, lambda p: ~p["type"].eqNullSafe("text")),
        lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), expanded(p).alias("tokens")),
    )
    rows = df.select(
        F.col(conv).alias(conv), F.col(turn).alias("_turn"), who.alias("_role"), head.alias("_head"), body.alias("_body"), extras.alias("_extras")
    )
    # The struct's order is the order of turns; collect_list of it needs each text once.
    grouped = rows.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct("_turn", "_role", "_head", "_body", "_extras"))).alias("t"))
    return grouped.select(
        conv,
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda t: F.concat(t["_head"], t["_body"], F.lit(END))), "").alias("formatted"),
        F.transform(
            "t",
            lambda t: F.struct(
                F.length(t["_head"]).alias("skip"), F.when(t["_role"] == "assistant", F.length(t["_body"])).otherwise(0).alias("take")
            ),
        ).alias("mask"),
        F.flatten(F.transform("t", lambda t: t["_extras"])).alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_back(df: DataFrame) -> DataFrame:
    """Add ``turns``: array of (role, text, loss), parsed from ``formatted`` and ``mask`` alone; loss: the unescaped text under the mask."""
    # " </turn>\n" holds an unescaped "<", so it only ends turns.
    pieces = F.slice(F.split("formatted", END), 1, F.size("mask"))

    def parse(p: Column, m: Column) -> Column:
        inner = F.regexp_extract(p, r"^### ((?:[^:\\]|\\.)*+): ", 1)
        at = F.length(inner) + 7
        return F.struct(
            _read_role(inner).alias("role"),
            unescape(F.substr(p, at)).alias("text"),
            unescape(F.substr(p, m["skip"] + 1, m["take"])).alias("loss"),
        )

    return df.withColumn("turns", F.zip_with(pieces, F.col("mask"), parse))
