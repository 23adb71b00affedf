"""Quality rules: measures of each text, and lines that many documents of one host share.

Native: every step is a DataFrame or SQL function.

A line is normalised (lower case, white space runs to one blank, trimmed) and hashed.  For
each host and line the *different* documents that hold it are counted; copies of one text must not
make its lines look like boilerplate, so documents whose whole normalised texts are equal count as one.
A line over the limits is boilerplate on that host and is removed; a document that loses more than
``depleted`` percent of its words is rejected.

Skew: documents are told apart in a first aggregate keyed by (host, line, document), whose keys are
spread evenly whatever the host; only its rows, already unique, are counted by (host, line), summed
on the map side first.  The lines over the limits are few; they meet the documents' lines in an
equi-join that Spark may split or broadcast by measured size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.llm.base import blanks, cut, pick, words

SYMBOLS = "[#*$%&|<>]+"


@dataclass(frozen=True)
class LineLimits:
    """``documents`` and ``percent``: a line in at least so many different documents of a host, and in
    at least that share of them, is removed.  ``depleted``: percent of words whose loss rejects."""

    documents: int = 10
    percent: int = 8
    depleted: int = 50
    least_words: int = 50
    repeated: int = 50


def _lines(frame: DataFrame) -> DataFrame:
    """Adds ``_lines``: the normalised lines of ``text`` that hold a word.  The text is normalised as a whole."""
    frame = frame.withColumn("_text", F.lower(blanks(F.col("text"), keep="\n")))
    double = F.instr("_text", "  ") > 0
    frame = frame.withColumn("_text", F.when(double, F.regexp_replace("_text", " {2,}", " ")).otherwise(F.col("_text")))
    return frame.withColumn("_lines", F.filter(F.transform(F.split("_text", "\n"), lambda x: F.trim(x)), lambda x: x != "")).drop("_text")


def _repeated_words(frame: DataFrame) -> DataFrame:
    """Adds n_repeat_words from ``w``: words inside any 3-word window that occurs twice or more.

    Words are hashed once, windows from three hashes.  The windows' hashes are sorted with their
    positions; equal neighbours mark repeated windows.  Texts whose windows all differ skip the sort."""
    frame = frame.withColumn("_w", F.transform("w", lambda x: F.xxhash64(x)))
    frame = frame.withColumn(
        "_hashes",
        F.expr("CASE WHEN size(_w) > 3 THEN transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) END"),
    )
    frame = frame.withColumn(
        "_windows",
        F.expr(
            "CASE WHEN size(array_distinct(_hashes)) < size(_hashes) "
            "THEN sort_array(transform(_hashes, (h, i) -> struct(h, i))) END"
        ),
    )
    frame = frame.withColumn(
        "_repeats",
        F.expr(
            "transform(filter(zip_with(_windows, slice(_windows, 2, size(_windows)), (x, y) -> struct(x.i AS i, y.i AS k, x.h = y.h AS same)), "
            "p -> p.same), p -> array(p.i, p.i + 1, p.i + 2, p.k, p.k + 1, p.k + 2))"
        ),
    )
    return frame.withColumn(
        "n_repeat_words", F.expr("CASE WHEN _windows IS NULL THEN 0 ELSE size(array_distinct(flatten(_repeats))) END").cast("long")
    ).drop("_w", "_hashes", "_windows", "_repeats")


def measures(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """Adds the measures of each text (column ``text``; null: no words) to its row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    frame = docs.withColumn("w", words(F.col("text"))).withColumn(
        "_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    frame = _repeated_words(frame)
    frame = frame.withColumn("n_words", F.size("w").cast("long")).withColumns(
        {
            "word_chars": F.length(F.array_join("w", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "base_failed": (F.col("n_words") < limits.least_words)
            | (100 * F.col("n_repeat_words") > limits.repeated * F.col("n_words")),
        }
    )
    return frame.drop("w", "_lines")


def document_lines(docs: DataFrame) -> DataFrame:
    """One row per line: host, line hash, and the hash of the document's normalised lines, which copies share.

    A document with lines has one row more, whose line is that hash itself."""
    frame = _lines(docs.select("host", "text")).drop("text")
    each = F.transform("_lines", lambda x: F.xxhash64(x))
    # in two steps: beside the explode, the lines would be hashed once for each line.  A plain
    # explode would add a filter on the array's size below, and so build the lines twice
    frame = frame.select("host", each.alias("_hashes"))
    frame = frame.select("host", F.xxhash64("_hashes").alias("same"), F.array_distinct("_hashes").alias("_hashes"))
    own = F.when(F.size("_hashes") > 0, F.array("same")).otherwise(F.array().cast("array<bigint>"))
    frame = frame.select("host", "same", F.concat("_hashes", own).alias("_hashes"))
    return frame.select("host", "same", F.explode_outer("_hashes").alias("line")).where("line IS NOT NULL")


def common_lines(lines: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """(host, line) of the lines over both limits.

    A host's different documents are counted from the same table: its rows for whole documents."""
    counted = lines.distinct().groupBy("host", "line").agg(
        F.count("*").alias("documents"), F.max((F.col("line") == F.col("same")).cast("int")).alias("whole")
    )
    hosts = counted.groupBy(F.col("host").alias("_host")).agg(F.sum("whole").alias("of"))
    return (
        counted.where((F.col("whole") == 0) & (F.col("documents") >= limits.documents))
        .join(hosts, F.col("host").eqNullSafe(F.col("_host")))
        .where(100 * F.col("documents") >= limits.percent * F.col("of"))
        .select("host", "line", "documents")
    )


def removed_words(docs: DataFrame, common: DataFrame) -> DataFrame:
    """(key, n_removed_words): words of each document in the common lines; repeated rows count once."""
    each = F.transform(
        "_lines",
        lambda x: F.struct(F.xxhash64(x).alias("line"), F.size(F.split(x, " ")).alias("n")),
    )
    lines = _lines(docs).select("host", "key", F.posexplode_outer(each).alias("place", "x")).where("x IS NOT NULL").select("host", "key", "place", "x.line", "x.n")
    found = common.select(F.col("host").alias("_host"), F.col("line").alias("_line"))
    return (
        lines.join(found, (F.col("line") == F.col("_line")) & F.col("host").eqNullSafe(F.col("_host")), "left_semi")
        .groupBy("key", "place")
        .agg(F.max("n").alias("n"))
        .groupBy(F.col("key").alias("_key"))
        .agg(F.sum("n").alias("n_removed_words"))
    )


def boilerplate(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", limits: LineLimits = LineLimits()) -> DataFrame:
    """(host, line, documents) of the lines over the limits, computed once for ``judge`` and ``without_lines``."""
    return cut(common_lines(document_lines(pick(docs, text=text_col, host=host_col)), limits))


def without_lines(docs: DataFrame, common: DataFrame, *, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` and all their columns; from ``text_col`` the lines in ``common`` are taken out.

    All other lines stay as they are, in their order.  A host's lines over the limits meet the rows as
    one array, so no text is split over rows or shuffled for it; other hosts' texts are untouched."""
    lists = common.groupBy(F.col("host").alias("_host")).agg(F.collect_set("line").alias("_common"))
    frame = docs.join(lists, F.col(f"`{host_col}`").eqNullSafe(F.col("_host")), "left")
    # as in _lines, but with the lines that hold no word: both arrays have one entry for each line
    normal = F.lower(blanks(F.col(f"`{text_col}`"), keep="\n"))
    normal = F.transform(F.split(normal, "\n"), lambda x: F.xxhash64(F.trim(F.regexp_replace(x, " {2,}", " "))))
    both = F.arrays_zip(F.split(F.col(f"`{text_col}`"), "\n").alias("raw"), normal.alias("line"))
    left = F.filter(both, lambda x: ~F.array_contains("_common", x["line"]))
    text = F.array_join(F.transform(left, lambda x: x["raw"]), "\n")
    cleaned = F.when(F.col("_common").isNull() | F.col(f"`{text_col}`").isNull(), F.col(f"`{text_col}`")).otherwise(text)
    return frame.withColumn(text_col, cleaned).select(*(F.col(f"`{name}`") for name in docs.columns))


def judge(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    limits: LineLimits = LineLimits(),
    common: DataFrame | None = None,
) -> DataFrame:
    """One row per input row: ``doc_id``, the measures, ``n_removed_words``, ``base_failed``, ``kept``.

    Null text: no words, base_failed.  Null host: a host of its own.  Null id: kept as null.  Repeated
    rows: the same verdict for each.  Empty table: no rows.  Other columns are ignored.  The result is
    computed and written to the shared folder (a few numbers a document).  ``common``: the result of
    ``boilerplate``, if it is there already.
    """
    plain = pick(docs, doc_id=id_col, text=text_col, host=host_col)
    plain = plain.withColumn("key", F.xxhash64("doc_id", "host", "text"))
    removed = removed_words(plain, common_lines(document_lines(plain), limits) if common is None else common)
    judged = measures(plain, limits).drop("text", "host")
    joined = judged.join(removed, judged["key"] == removed["_key"], "left").drop("key", "_key")
    lost = F.coalesce(F.col("n_removed_words"), F.lit(0)).cast("long")
    verdicts = joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (100 * lost <= limits.depleted * F.col("n_words"))).alias("kept"),
        lost.alias("n_removed_words"),
    )
    # computed here: a filter on the verdict would otherwise be pushed below the measures, and their
    # array expressions be put into one another and evaluated once for each element
    return cut(verdicts)
