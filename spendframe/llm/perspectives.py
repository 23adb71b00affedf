"""Chat formatting: every conversation from the seat of each of its speakers.  Native.

For each speaker the dialogue is rendered with that speaker as the assistant and all others as named
users; ``mask`` has the places of the assistant's own words, which a loss is taken on.

A conversation of up to ``part_chars`` rendered characters is one row a speaker, made in one exchange.  A
longer one comes in parts by size and position.  Its turns get their places from ranges of the order: dealt
by range, summed by range, added up within, so that no conversation is sorted in one task.  ``start``
and ``mask`` count from the beginning of the speaker's dialogue, whichever part they are in: parts in
order are one dialogue with one mask.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendframe.llm.base import cut, pick

END = "<|end|>\n"
OWN = "<|assistant|>\n"
#: Tasks that the parts of one conversation are dealt to, at most, when they meet its speakers.
LANES = 64
ORDER = ("turn", "role", "text")


def _plain(text: Column) -> Column:
    """Text that can't close or open a marker of its own."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _sum_before(size: str, by: tuple[str, ...], order: tuple[str, ...]) -> Column:
    rows = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(size).over(rows), F.lit(0))


def _same(left: DataFrame, right: DataFrame, *names: str, how: str = "inner") -> DataFrame:
    """Join on equal names, where null equals null."""
    other = right.withColumnsRenamed({name: f"_{name}" for name in names})
    on = [left[name].eqNullSafe(other[f"_{name}"]) for name in names]
    return left.join(other, on, how).drop(*[f"_{name}" for name in names])


def _gathered(rows: DataFrame) -> DataFrame:
    """A row a conversation and part, with its turns in order; ``at`` tells them apart, as no rendered turn is empty."""
    return rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text"))).alias("turns"))


def _whole(rows: DataFrame, speaks: Callable[[Column], Column]) -> DataFrame:
    """The seats of conversations of one part: speakers are found in the row itself."""
    seats = _gathered(rows.withColumns({"at": _sum_before("size", ("conv_id",), ORDER), "part": F.lit(0).cast("long")}))
    names = F.array_distinct(F.transform(F.filter("turns", lambda t: speaks(t["role"])), lambda t: t["role"]))
    return seats.withColumn("before", F.lit(0).cast("long")).select("*", F.explode(names).alias("speaker"))


def _in_parts(rows: DataFrame, speaks: Callable[[Column], Column], part_chars: int) -> DataFrame:
    """The seats of longer conversations; ``before`` is the number of the speaker's turns in earlier parts."""
    opening = F.substring("text", 1, 128)  # bounds of the ranges pass the driver: no whole texts in them
    dealt = cut(rows.repartitionByRange("conv_id", "turn", "role", opening).withColumn("range", F.spark_partition_id()))
    sums = dealt.groupBy("conv_id", "range").agg(F.sum("size").alias("chars"))
    sums = sums.select("conv_id", "range", _sum_before("chars", ("conv_id",), ("range",)).alias("earlier"))
    placed = _same(dealt.withColumn("inner", _sum_before("size", ("conv_id", "range"), ORDER)), sums, "conv_id", "range")
    placed = placed.withColumn("at", F.col("earlier") + F.col("inner"))
    placed = cut(placed.select("conv_id", "role", "text", "at", F.expr(f"at div {part_chars}").alias("part")))

    said = placed.groupBy("conv_id", "part", "role").agg(F.count("*").alias("own"))
    parts = said.select("conv_id", "part").distinct().withColumn("lane", F.pmod("part", F.lit(LANES)))
    people = said.where(speaks(F.col("role"))).select("conv_id", F.col("role").alias("speaker")).distinct()
    people = _same(people, parts.select("conv_id", "lane").distinct(), "conv_id")
    seats = _same(parts, people, "conv_id", "lane").drop("lane")
    seats = _same(seats, said.withColumnRenamed("role", "speaker"), "conv_id", "part", "speaker", how="left")
    seats = seats.withColumn("before", _sum_before("own", ("conv_id", "speaker"), ("part",))).drop("own")
    return _same(_gathered(placed), seats, "conv_id", "part")


def rotate(
    turns: DataFrame,
    *,
    part_chars: int = 1 << 18,
    instructions: tuple[str, ...] = ("system",),
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per conversation, part and speaker: ``conv_id``, ``part``, ``speaker``, ``n_turns``, ``start``, ``text``, ``mask``.

    A turn is in part ``p`` if ``p * part_chars`` to ``(p + 1) * part_chars - 1`` characters come before it, with
    all speakers rendered as users; a part is longer than that by one turn at most, and there may be numbers
    without a part after a very long turn.  ``start`` is where the part's ``text`` begins in the speaker's dialogue,
    ``mask`` an array of (start, end) in code points of that dialogue, empty where the speaker is silent in the part.

    Roles in ``instructions`` speak for no one and stay instructions.  A null role is the speaker "unknown",
    a null text is empty, a null turn comes first, a null conversation is one of its own.  Equal turn numbers go
    by role and text; repeated rows are repeated turns.  Other columns are ignored; an empty table gives no rows.
    """
    if part_chars < 1:
        raise ValueError("part_chars must be positive")

    def speaks(role: Column) -> Column:
        return ~role.isin(*instructions)

    def user(role: Column) -> Column:
        return F.concat(F.when(speaks(role), F.lit("<|user:")).otherwise(F.lit("<|")), role, F.lit("|>\n"))

    role = _plain(F.coalesce(F.col("role"), F.lit("unknown")))
    rows = pick(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    rows = rows.select("conv_id", "turn", role.alias("role"), _plain(F.col("text")).alias("text"))
    rows = rows.withColumn("size", (F.length(user(F.col("role"))) + F.length("text") + len(END)).cast("long"))
    # written, so that its size is known when the joins with it are planned
    longer = cut(rows.groupBy("conv_id").agg(F.sum("size").alias("chars")).where(F.col("chars") > part_chars).select("conv_id"))
    seats = _whole(_same(rows, longer, "conv_id", how="left_anti"), speaks)
    seats = seats.unionByName(_in_parts(_same(rows, longer, "conv_id", how="left_semi"), speaks, part_chars))

    saved = F.length("speaker") + len("<|user:|>\n") - len(OWN)  # what a turn of the speaker's own is shorter by
    first = F.col("turns")[0]["at"] - F.col("before") * saved

    def span(turn: Column, number: Column) -> Column:
        begin = turn["at"] - (F.col("before") + number) * saved + len(OWN)
        return F.struct(begin.alias("start"), (begin + F.length(turn["text"])).alias("end"))

    def rendered(turn: Column) -> Column:
        head = F.when(turn["role"] == F.col("speaker"), F.lit(OWN)).otherwise(user(turn["role"]))
        return F.concat(head, turn["text"], F.lit(END))

    return seats.select(
        "conv_id",
        "part",
        "speaker",
        F.size("turns").cast("long").alias("n_turns"),
        first.alias("start"),
        F.array_join(F.transform("turns", rendered), "").alias("text"),
        F.transform(F.filter("turns", lambda t: t["role"] == F.col("speaker")), span).alias("mask"),
    )
