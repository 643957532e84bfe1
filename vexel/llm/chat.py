"""Chat formatting in Spark expressions.

Template: each run of adjacent turns of one role becomes one block
``<|im_start|>ROLE\\nTEXT[<|im_sep|>TEXT...]<|im_end|>\\n``. Inside texts ``&`` is written ``&amp;`` and
``<|`` is written ``&lt;|``, in roles a line feed is written ``&nl;`` too, so that no text can forge a
control string and the output can be read back exactly.

Defined cases: null texts and null roles count as empty; turns sort by (turn, role, text), nulls first, so
ties and repeated rows have one order; rows with null conv_id form one conversation; an empty table gives an
empty result; other columns are ignored. A conversation is one output row, so its text must fit in a row (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def format_conversations(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, blocks, formatted.

    ``blocks`` holds for each merged block its role, its text as formatted, and the spans under the loss mask
    (start from 1 and length, in code points of the block). ``formatted`` is all blocks on end.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def is_start(_: Column, i: Column) -> Column:
        # get() gives null outside of the array
        return (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"])

    marked = turns.withColumn("starts", F.filter(F.transform("turns", lambda t, i: F.when(is_start(t, i), i)), lambda x: x.isNotNull()))

    def block(start: Column, k: Column) -> Column:
        stop = F.coalesce(F.get("starts", k + 1), F.size("turns"))
        run = F.slice("turns", start + 1, stop - start)
        role = F.get("turns", start)["role"]
        return F.struct(role.alias("role"), F.transform(run, lambda t: escape(t["text"])).alias("texts"))

    runs = marked.select("conv_id", F.transform("starts", block).alias("runs"))

    def render(run: Column) -> Column:
        head = F.concat(F.lit(START), F.replace(escape(run["role"]), F.lit("\n"), F.lit("&nl;")), F.lit("\n"))
        text = F.concat(head, F.array_join(run["texts"], SEP), F.lit(f"{END}\n"))
        first = F.char_length(head) + 1
        spans = F.aggregate(
            run["texts"],
            F.struct(first.alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("out")),
            lambda acc, t: F.struct(
                (acc["at"] + F.char_length(t) + len(SEP)).alias("at"),
                F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), F.char_length(t).alias("length")))).alias("out"),
            ),
            lambda acc: acc["out"],
        )
        none = F.array().cast("array<struct<start:int,length:int>>")
        return F.struct(run["role"].alias("role"), text.alias("text"), F.when(run["role"] == loss_role, spans).otherwise(none).alias("loss"))

    blocks = runs.select("conv_id", F.transform("runs", render).alias("blocks"))
    return blocks.withColumn("formatted", F.array_join(F.transform("blocks", lambda b: b["text"]), ""))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text as given) and loss_text, from ``formatted`` and the mask alone."""
    body = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda x: x != "")

    def one(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        plain = unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))
        # what stands after the role's line, without the end mark and its line feed
        rest = F.substring(block, F.char_length(role) + 2, F.char_length(block) - F.char_length(role) - 1 - len(END) - 1)
        return F.transform(F.split(rest, r"<\|im_sep\|>"), lambda t: F.struct(plain.alias("role"), unescape(t).alias("text")))

    masked = F.transform("blocks", lambda b: F.array_join(F.transform(b["loss"], lambda s: unescape(F.substring(b["text"], s["start"], s["length"]))), ""))
    return formatted.select("conv_id", F.flatten(F.transform(body, one)).alias("turns"), F.array_join(masked, "").alias("loss_text"), "formatted")
