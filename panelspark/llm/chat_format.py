"""Chat formatting with Spark expressions only.

A conversation's turn structs are sorted, adjacent turns of one role are merged into a block with an
array aggregation, and the blocks are concatenated under a template. Control strings that occur in
a text or a role get a backslash after their first character and backslashes are doubled, so only
the template's own marks are literal and ``parse`` reads every turn back unchanged.

Null texts and roles are empty strings; null turn numbers sort first, ties by role and text; repeated
rows are turns of their own; rows without a conversation id form one conversation with a null id.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks of a block: begin, end of the role, boundary of merged turns, end."""

    begin: str = "<|im_start|>"
    head: str = "<|im_head|>\n"
    join: str = "<|im_next|>"
    end: str = "<|im_end|>\n"
    foreign: Sequence[str] = field(default=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>"))

    @property
    def controls(self) -> list[str]:
        return [m.strip("\n") for m in (self.begin, self.head, self.join, self.end)] + list(self.foreign)


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "_ \n" else c for c in text)


def escape(text: Column, t: Template) -> Column:
    """Doubles backslashes and breaks every control string after its first character."""
    first = {c[0] for c in t.controls}
    rests = {f: "|".join(_quoted(c[1:]) for c in t.controls if c[0] == f) for f in sorted(first)}
    pattern = "|".join(f"{_quoted(f)}(?={r})" for f, r in rests.items())
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(f"({pattern})"), F.lit("$1\\\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation with its sorted array of turn structs."""
    pick = turns.select(
        turns[conv].alias("conv_id"), turns[turn].alias("turn"),
        F.coalesce(turns[role].cast("string"), F.lit("")).alias("role"), F.coalesce(turns[text].cast("string"), F.lit("")).alias("text"),
    )
    return pick.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def merged_blocks(turns: Column) -> Column:
    """Array of blocks (role, texts): runs of adjacent turns of one role, by slices between role changes."""
    begins = F.filter(F.sequence(F.lit(1), F.size(turns)), lambda i: (i == 1) | (F.element_at(turns, F.greatest(i - 1, F.lit(1))).role != F.element_at(turns, i).role))

    def block(i: Column, k: Column) -> Column:
        stop = F.coalesce(F.get(begins, k + 1), F.size(turns) + 1)
        return F.struct(F.element_at(turns, i).role.alias("role"), F.transform(F.slice(turns, i, stop - i), lambda x: x.text).alias("texts"))

    return F.transform(begins, block)


def format_chat(turns: DataFrame, template: Template | None = None, loss_roles: Sequence[str] = ("assistant",), **columns: str) -> DataFrame:
    """conv_id, formatted text, and the spans (start, length in code points) that bear loss."""
    t = template or Template()
    convs = conversations(turns, **columns).select("conv_id", merged_blocks(F.col("turns")).alias("blocks"))
    pieces = convs.select(
        "conv_id",
        F.transform(
            "blocks",
            lambda b: F.struct(
                F.concat(F.lit(t.begin), escape(b.role, t), F.lit(t.head)).alias("head"),
                F.array_join(F.transform(b.texts, lambda x: escape(x, t)), t.join).alias("body"),
                b.role.isin(*loss_roles).alias("loss"),
            ),
        ).alias("pieces"),
    )
    sizes = F.transform("pieces", lambda p: F.length(p["head"]) + F.length(p["body"]) + len(t.end))
    total = F.aggregate(sizes, F.lit(0), lambda a, n: a + n)
    offsets = F.aggregate(
        sizes, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")),
    )["all"]
    spans = F.filter(
        F.zip_with("pieces", "_offsets", lambda p, o: F.struct((o + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("n"), p["loss"].alias("loss"))),
        lambda s: s["loss"],
    )
    return pieces.withColumn("_offsets", offsets).select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(t.end))), "").alias("formatted"),
        F.transform(spans, lambda s: F.struct(s["start"].cast("long").alias("start"), s["n"].cast("long").alias("length"))).alias("loss_spans"),
        total.cast("long").alias("n_chars"),
    )


def parse(formatted: Column, template: Template | None = None) -> Column:
    """Array of (role, text) turns read back from a formatted conversation."""
    t = template or Template()
    blocks = F.filter(F.split(formatted, _quoted(t.end), -1), lambda b: b != "")

    def turns(b: Column) -> Column:
        parts = F.split(F.substring(b, len(t.begin) + 1, 2**31 - 1), _quoted(t.head), 2)
        role = unescape(F.get(parts, F.lit(0)))
        texts = F.split(F.get(parts, F.lit(1)), _quoted(t.join), -1)
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def digest(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation what reading the formatted text back gives: turns, loss text, sizes."""
    t = template or Template()
    under_mask = F.transform("loss_spans", lambda s: F.array_join(F.transform(F.split(F.substring("formatted", s["start"].cast("int") + 1, s["length"].cast("int")), _quoted(t.join), -1), unescape), ""))
    read = formatted.select("conv_id", "formatted", parse(F.col("formatted"), t).alias("turns"), F.array_join(under_mask, "").alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
