"""Chat formatting with typed content parts.

A message holds parts (text, image, audio, document).  A visitor expression flattens them in order: text is
escaped, everything else becomes a placeholder plus an attachment record with its expanded token count.
Conversations are rendered in a turn template whose control strings cannot be forged by content, and the
output can be read back exactly.  Main path: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
NEWLINE_IN_ROLE = "<|nl|>"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256
#: placeholders of parts that are no text; escaped text never holds ``<|``, so no text looks like one
HOLDER = r"<\|(image|audio|document)\|>"


def escape(text: Column) -> Column:
    """Reversible: afterwards ``<|`` never occurs, not even across the border to a neighbouring part."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.when(out.startswith("|"), F.concat(F.lit("\\"), out)).otherwise(out)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _visit(part: Column) -> Column:
    """(piece, kind, ref, tokens) of one part; an unknown kind with text counts as text, else it is skipped."""
    kind = F.lower(F.coalesce(part["type"], F.lit("text")))
    tokens = (
        F.when(kind == "image", F.ceil(F.coalesce(part["width"], F.lit(PATCH)) / PATCH) * F.ceil(F.coalesce(part["height"], F.lit(PATCH)) / PATCH))
        .when(kind == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .when(kind == "document", F.coalesce(part["pages"], F.lit(1)) * PAGE_TOKENS)
    )
    holder = F.concat(F.lit("<|"), kind, F.lit("|>"))
    return F.struct(
        F.when(tokens.isNotNull(), holder).otherwise(escape(F.coalesce(part["text"], F.lit("")))).alias("piece"),
        kind.alias("kind"),
        part["ref"].alias("ref"),
        tokens.cast("long").alias("tokens"),
    )


def flatten_parts(parts: Column) -> tuple[Column, Column, Column]:
    """(content, attachments, expanded tokens) of an array of parts; null or empty parts give empty content.

    ``attachments`` keeps the order of the placeholders: (kind, ref, tokens).
    """
    seen = F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), _visit)
    files = F.filter(seen, lambda x: x["tokens"].isNotNull())
    attachments = F.transform(files, lambda x: F.struct(x["kind"].alias("kind"), x["ref"].alias("ref"), x["tokens"].alias("tokens")))
    total = F.aggregate(files, F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    return F.array_join(F.transform(seen, lambda x: x["piece"]), ""), attachments, total


def text_parts(text: Column) -> Column:
    """A plain text as the only part of a message."""
    absent = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(
        F.struct(
            F.lit("text").alias("type"),
            F.coalesce(text, F.lit("")).alias("text"),
            *[F.lit(None).cast(kind).alias(name) for name, kind in absent.items()],
        )
    )


def format_conversations(messages: DataFrame, parts: str = "parts") -> DataFrame:
    """Render (conv_id, turn, role, parts) rows: conv_id, formatted, attachments, expanded_tokens.

    Turns are ordered by turn, role, content, so repeated turns have one defined order; a null turn comes first,
    a null role or text is empty.  One conversation is one output string, as any chat template needs.  Rows with a null
    conv_id are one conversation; other columns are ignored; an empty table gives an empty result.
    """
    content, attachments, tokens = flatten_parts(F.col(parts))
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit(NEWLINE_IN_ROLE))
    turns = messages.select("conv_id", "turn", role.alias("role"), content.alias("content"), attachments.alias("files"), tokens.alias("tokens"))
    grouped = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "content", "files"))).alias("turns"), F.sum("tokens").alias("expanded_tokens")
    )
    rendered = F.transform("turns", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["content"], F.lit(END + "\n")))
    return grouped.select(
        "conv_id",
        F.array_join(rendered, "").alias("formatted"),
        F.flatten(F.transform("turns", lambda t: t["files"])).alias("attachments"),
        "expanded_tokens",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse ``formatted`` strings: conv_id, formatted, turns array<struct<role, content, text, kinds, loss>>, other columns.

    ``content`` is what stands between the marks, ``text`` the original text without placeholders, ``kinds`` those of the
    placeholders in order, ``loss`` marks assistant turns (of which the text alone is trained on).
    """
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda x: x != "")

    def turn(piece: Column) -> Column:
        body = F.substring(piece, len(START) + 1, 2**31 - 1)
        name = F.substring_index(body, "\n", 1)
        content = body.substr(F.length(name) + 2, F.lit(2**31 - 1))
        role = unescape(F.replace(name, F.lit(NEWLINE_IN_ROLE), F.lit("\n")))
        text = unescape(F.regexp_replace(content, HOLDER, ""))
        kinds = F.regexp_extract_all(content, F.lit(HOLDER), F.lit(1))
        return F.struct(role.alias("role"), content.alias("content"), text.alias("text"), kinds.alias("kinds"), (role == "assistant").alias("loss"))

    return formatted.withColumn("turns", F.transform(pieces, turn))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Digests of what the output says when it is read back (see :func:`read_back`), with attachments and expanded_tokens."""
    back = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "attachments",
        "expanded_tokens",
    )
