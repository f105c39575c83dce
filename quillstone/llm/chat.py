"""Chat formatting with typed content parts, in DataFrame expressions only.

A message's content is a list of parts: text, image, audio or document.  Plain text is
taken apart first: links and embedded data (`data:` URIs, Markdown images) of these
kinds become parts of their own.  A visitor (one branch for each kind, inside one
expression) flattens the parts in order into the message's body: text is escaped, every
other part becomes its placeholder, its reference goes to the list of attachments and
its expanded token count is noted.
Messages become turns `<|turn|>role\\nbody<|end|>`; control strings inside texts
and roles are escaped reversibly, so the formatted conversation can be read back, with
each placeholder's reference in its place.
The loss mask is a list of runs (length in code points, under loss or not) that
covers the formatted conversation; assistant bodies are under loss.

How it runs.  Escaping and flattening happen before the shuffle, row by row.  One
shuffle by conversation brings the turns together, since a formatted conversation
is one value; a single conversation must therefore fit in memory, its output does
too.  Nothing else is gathered.

Defined results.  Null text: empty.  Null role: empty.  Null or unknown kind of part:
read as text.  Equal turn numbers: ordered by role, then body.  Null conv_id: each such
row is a conversation of its own.  Repeated rows: repeated turns.  Empty table: empty
result.  Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import word_list

TURN, END = "<|turn|>", "<|end|>"
#: What each kind of part is replaced by, and the tokens that it expands to.
PLACEHOLDERS = {"image": ("<|image|>", 576), "audio": ("<|audio|>", 750), "document": ("<|document|>", 2048)}
#: Escapes, in the order in which they are applied.
ESCAPES = (("~", "~0"), ("<|", "~1"), ("</s>", "~2"), ("<s>", "~3"), ("[INST]", "~4"), ("[/INST]", "~5"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "~6"))
PART = "array<struct<kind:string,text:string,ref:string>>"
PLACEHOLDER = r"<\|(?:image|audio|document)\|>"
#: What makes a link or embedded data an image, audio or document part, by its ending or its media type.
ENDINGS = {"image": "png|jpe?g|gif|webp|svg|bmp", "audio": "mp3|wav|ogg|flac|m4a", "document": "pdf|docx?|xlsx?|pptx?|csv|odt"}
MEDIA = {"image": "image", "audio": "audio", "document": "application|text"}
_ANY_ENDING, _ANY_MEDIA = "|".join(ENDINGS.values()), "|".join(MEDIA.values())
#: One pattern for all of them, without groups but the whole.
ATTACHMENT = rf"!\[[^\]\n]*\]\([^)\s]+\)|data:(?:{_ANY_MEDIA})/[A-Za-z0-9.+-]+;base64,[A-Za-z0-9+/]+={{0,2}}|https?://[^\s<>()\"']+\.(?:{_ANY_ENDING})\b"


def escape(text: Column, pairs=ESCAPES) -> Column:
    for plain, coded in pairs:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, pairs=ESCAPES) -> Column:
    for plain, coded in reversed(pairs):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _part(kind: Column, text: Column, ref: Column) -> Column:
    return F.struct(kind.alias("kind"), text.alias("text"), ref.alias("ref"))


def kind_of(found: Column) -> Column:
    """What kind of part a link or embedded data is; a Markdown image is an image unless its ending says otherwise."""
    out = F.when(found.startswith("!["), F.lit("image")).otherwise(F.lit("document"))
    for kind in reversed(ENDINGS):
        out = F.when(found.rlike(rf"^data:(?:{MEDIA[kind]})/|\.(?:{ENDINGS[kind]})\)?$"), F.lit(kind)).otherwise(out)
    return out


def text_parts(text: Column) -> Column:
    """The content of a plain message: its texts, and the links and data between them as parts."""
    text, nothing = F.coalesce(text, F.lit("")), F.lit(None).cast("string")
    plain = F.array(_part(F.lit("text"), text, nothing))

    def apart(found: Column) -> Column:
        both = F.zip_with(F.split(text, ATTACHMENT, -1), found, lambda t, x: F.array(_part(F.lit("text"), t, nothing), F.when(x.isNotNull(), _part(kind_of(x), nothing, x))))
        return F.array_compact(F.flatten(both))

    # most messages hold nothing of the kind, and are looked through once
    return F.when(text.rlike(ATTACHMENT), apart(F.regexp_extract_all(text, F.lit(f"({ATTACHMENT})"), F.lit(1)))).otherwise(plain).cast(PART)


def visit(part: Column) -> Column:
    """body, ref and tokens of one part."""
    body, tokens, ref = escape(F.coalesce(part["text"], F.lit(""))), F.size(word_list(F.coalesce(part["text"], F.lit("")))), F.lit(None).cast("string")
    for kind, (placeholder, n) in PLACEHOLDERS.items():
        here = part["kind"] == kind
        body, tokens, ref = F.when(here, F.lit(placeholder)).otherwise(body), F.when(here, F.lit(n)).otherwise(tokens), F.when(here, F.coalesce(part["ref"], F.lit(""))).otherwise(ref)
    return F.struct(body.alias("body"), ref.alias("ref"), tokens.cast("long").alias("tokens"))


def format_parts(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, mask, refs (one list for each turn), attachments and n_tokens from messages (conv_id, turn, role, parts)."""
    # rows without an id must not meet in one task
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    seen = messages.select("conv_id", alone.alias("alone"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.transform("parts", visit).alias("parts"))
    turns = seen.select(
        "conv_id",
        "alone",
        F.struct(
            "turn", "role", F.array_join("parts.body", "").alias("body"), F.array_compact("parts.ref").alias("refs"),
            F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["tokens"]).alias("tokens"),
        ).alias("t"),
    )
    whole = turns.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(TURN), escape(t["role"], ROLE_ESCAPES), F.lit("\n"))
    run = lambda n, loss: F.struct(n.alias("n"), loss.alias("loss"))
    runs = lambda t: F.array(run(F.length(head(t)), F.lit(False)), run(F.length(t["body"]), t["role"] == "assistant"), run(F.lit(len(END)), F.lit(False)))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["body"], F.lit(END))), "").alias("formatted"),
        F.flatten(F.transform("turns", runs)).alias("mask"),
        F.col("turns.refs").alias("refs"),
        F.flatten("turns.refs").alias("attachments"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("n_tokens"),
    )


def format_texts(rows: DataFrame) -> DataFrame:
    """The same from rows (conv_id, turn, role, text)."""
    return format_parts(rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", text_parts(F.col("text")).alias("parts")))


def restored(body: Column, refs: Column) -> Column:
    """The text of a body: unescaped, with the references in the place of their placeholders."""
    pieces = F.zip_with(F.split(body, PLACEHOLDER, -1), refs, lambda t, ref: F.concat(unescape(F.coalesce(t, F.lit(""))), F.coalesce(ref, F.lit(""))))
    return F.when(F.size(refs) > 0, F.array_join(pieces, "")).otherwise(unescape(body))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (role and text, unescaped) and loss_text, both taken from the formatted string, the mask and the references."""
    coded = F.slice(F.split("formatted", r"<\|end\|>"), 1, F.size(F.split("formatted", r"<\|end\|>")) - 1)
    role = lambda x: F.substring_index(F.substring(x, len(TURN) + 1, 1 << 30), "\n", 1)
    turns = F.transform("_coded", lambda x, i: F.struct(unescape(role(x), ROLE_ESCAPES).alias("role"), restored(F.substring(x, F.instr(x, "\n") + 1, F.length(x)), F.get("refs", i)).alias("text")))
    # run 3i + 1 of the mask is the end of turn i
    under = F.transform("_coded", lambda x, i: F.when(F.get("mask", 3 * i + 1)["loss"], restored(F.right(x, F.get("mask", 3 * i + 1)["n"]), F.get("refs", i))))
    return formatted.withColumn("_coded", coded).withColumns({"turns": turns, "loss_text": F.array_join(F.array_compact(under), "")}).drop("_coded")
