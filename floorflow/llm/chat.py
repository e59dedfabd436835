"""Chat formatting by DataFrame expressions.

Turns of a conversation are collected, sorted, and adjacent turns of one role
merged; a template marks roles and turns.  Control strings inside texts and
roles are broken by a backslash, and backslashes are doubled, so the output
can be read back exactly.

    <s>[INST] user\\n{text}[NEXT]{text} [/INST]
    <s>assistant\\n{text}[NEXT]{text}</s>
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template (fixed values).
OPEN, CLOSE = "<s>", "</s>"
ASK, ASKED, NEXT = "[INST]", "[/INST]", "[NEXT]"
CONTROL = (OPEN, CLOSE, ASK, ASKED, NEXT)
LEARNED = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """``turns``: conv_id, turn, role, text.  A row per conversation: conv_id,
    formatted, and spans: start (code points from 0) and length of every
    learned text in ``formatted``.

    Null texts and roles are empty; null turns come first; rows of equal turn
    go by role, then text; repeated rows are turns of their own.  A null
    conv_id is a conversation.  Other columns are not looked at, and an empty
    table gives no rows.
    """
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("x"),
    )
    sorted_ = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("t"))
    n = F.size("t")
    first = F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda i: (i == 0) | ~F.get("t", i)["role"].eqNullSafe(F.get("t", F.greatest(i - 1, F.lit(0)))["role"]),
    )
    firsts = sorted_.withColumn("f", first).withColumn("n", n)
    # a block of each run of one role: the texts in order, escaped
    blocks = firsts.withColumn(
        "b",
        F.transform(
            "f",
            lambda s, k: F.struct(
                F.get("t", s)["role"].alias("role"),
                F.transform(
                    F.slice("t", s + 1, F.coalesce(F.get("f", k + 1), F.col("n")) - s), lambda x: escape(x["text"])
                ).alias("texts"),
            ),
        ),
    ).select("conv_id", "b")
    learned = lambda b: b["role"] == LEARNED
    head = lambda b: F.concat(
        F.lit(OPEN), F.when(learned(b), F.lit("")).otherwise(F.lit(ASK + " ")), escape_role(b["role"]), F.lit("\n")
    )
    tail = lambda b: F.when(learned(b), F.lit(CLOSE)).otherwise(F.lit(" " + ASKED))
    parts = blocks.select(
        "conv_id",
        F.transform(
            "b",
            lambda b: F.struct(
                learned(b).alias("learned"),
                head(b).alias("head"),
                b["texts"].alias("texts"),
                tail(b).alias("tail"),
            ),
        ).alias("p"),
    )
    # pieces in order, each with whether it is learned
    pieces = parts.select(
        "conv_id",
        F.flatten(
            F.transform(
                "p",
                lambda p: F.flatten(
                    F.array(
                        F.array(_piece(p["head"], F.lit(False))),
                        F.flatten(
                            F.transform(
                                p["texts"],
                                lambda x, i: F.when(i == 0, F.array(_piece(x, p["learned"]))).otherwise(
                                    F.array(_piece(F.lit(NEXT), F.lit(False)), _piece(x, p["learned"]))
                                ),
                            )
                        ),
                        F.array(_piece(p["tail"], F.lit(False))),
                    )
                ),
            )
        ).alias("pieces"),
    )
    sized = pieces.withColumn(
        "ends",
        F.aggregate(
            "pieces",
            F.struct(F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"), F.lit(0).cast("bigint").alias("at")),
            lambda acc, x: F.struct(
                F.when(
                    x["learned"],
                    F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), F.length(x["s"]).cast("bigint").alias("length")))),
                )
                .otherwise(acc["spans"])
                .alias("spans"),
                (acc["at"] + F.length(x["s"])).alias("at"),
            ),
        ),
    )
    return sized.select(
        "conv_id", F.array_join(F.transform("pieces", lambda x: x["s"]), "").alias("formatted"), F.col("ends.spans").alias("spans")
    )


def _piece(text: Column, learned: Column) -> Column:
    return F.struct(text.alias("s"), learned.alias("learned"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns (array of role and text) and learned texts from ``formatted`` and
    ``spans`` alone."""
    block = F.filter(F.split("formatted", "<s>", -1), lambda x: x != "")
    split = formatted.withColumn("blocks", block)
    role = lambda b: F.regexp_extract(b, r"(?s)^(?:\[INST\] )?((?:[^\\\n]|\\.)*)\n", 1)
    body = lambda b: F.regexp_replace(
        F.regexp_replace(b, r"(?s)^(?:\[INST\] )?(?:[^\\\n]|\\.)*\n", ""), r"(?s)(?:</s>| \[/INST\])\z", ""
    )
    return split.select(
        "*",
        F.flatten(
            F.transform(
                "blocks",
                lambda b: F.transform(
                    F.split(body(b), r"\[NEXT\]", -1),
                    lambda x: F.struct(unescape(role(b)).alias("role"), unescape(x).alias("text")),
                ),
            )
        ).alias("turns"),
        F.transform(
            "spans", lambda s: unescape(F.substring("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))
        ).alias("learned"),
    ).drop("blocks")


def digests(formatted: DataFrame) -> DataFrame:
    """The digest columns of op 10, read back from the output."""
    back = read_back(formatted)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.array_join("learned", "").alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    ).select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )
