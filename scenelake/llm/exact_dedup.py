"""Exact dedup: a tree merge of sorted digest runs, in DataFrame operations only.

Every input partition makes a run: its rows are aggregated by digest, one entry for each, with the row
count and the row that stays.  Runs lie in segments, ranges of digests.  They are exchanged in binomial
rounds: in round ``t`` the runs whose numbers agree above the lowest ``t * fan_bits`` bits meet, segment
by segment; a segment of a group is one place, where the entries of its runs are brought in order of
digest and merged in one pass.  There are as many rounds as it takes until one run is left, the root;
a round merges up to ``2**fan_bits`` runs.  Entries are only merged if, beside the digest, the length of
the normalised text and an independent hash of it agree, at every level.

What the root says goes back to the runs first and from there to their rows.  A hot text thus costs
one entry for each run, however many copies it has, and its copies are joined run by run.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.llm.common import ASCII_SPACE, P, shuffle_partitions, staged

#: Runs that meet in one merge, as a power of two.
FAN_BITS = 4
#: Row ids hold the partition above this bit.
_PARTITION_BIT = 33
#: What must agree if two texts are to be equal.
_TEXT = ["digest", "size", "check"]


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{ASCII_SPACE}+", "")


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One narrow row per document: id, code points; digest, length and hash of its normalised text."""
    norm = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.length(text_col), F.lit(0)).alias("points"),
        normalised(F.col(text_col)).alias("norm"),
    )
    return norm.select(
        "id",
        "points",
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.length("norm").alias("size"),
        F.xxhash64("norm").alias("check"),
        F.monotonically_increasing_id().alias("row"),
    )


def _merge(entries: DataFrame, place: list[str]) -> DataFrame:
    return entries.groupBy(*place, *_TEXT).agg(F.sum("n").alias("n"), F.min("best").alias("best"))


def _run() -> Column:
    return F.shiftright("row", _PARTITION_BIT)


def sorted_runs(rows: DataFrame) -> DataFrame:
    """The entries of every partition of ``rows`` of :func:`digests`: run, digest, size, check, n, best."""
    order = F.struct(
        (-F.col("points")).alias("points"), F.col("id").isNull().alias("no_id"), "id", "row"
    )
    own = rows.select(_run().alias("run"), *_TEXT, F.lit(1).cast("long").alias("n"), order.alias("best"))
    return _merge(own, ["run"])


def rounds(n_runs: int, fan_bits: int) -> int:
    """Rounds until ``n_runs`` runs are one; one at least, which brings segments together."""
    return max(1, math.ceil(max(0, n_runs - 1).bit_length() / fan_bits))


def merge_runs(runs: DataFrame, n_runs: int, fan_bits: int = FAN_BITS) -> DataFrame:
    """(digest, size, check, n, best): the root of the merge tree over :func:`sorted_runs`."""
    bits = min(16, max(5, math.ceil(math.log2(4 * shuffle_partitions(runs.sparkSession)))))
    segment = F.shiftright(F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int"), 16 - bits)
    place = ["run", "segment"]
    level = runs.withColumn("segment", segment)
    for _ in range(rounds(n_runs, fan_bits)):
        level = level.withColumn("run", F.shiftright("run", fan_bits))
        # one exchange a round: the merge finds its runs by place, in order, and needs no other
        level = _merge(level.repartition(*place).sortWithinPartitions(*place, *_TEXT), place)
    return level.select(*_TEXT, "n", "best")


def _decided(rows: DataFrame, fan_bits: int) -> DataFrame:
    """The staged rows of :func:`digests` with what the root says of their text."""
    n_runs = (rows.agg(F.max(_run()).alias("last")).first()["last"] or 0) + 1
    runs = sorted_runs(rows)
    root = merge_runs(runs, n_runs, fan_bits)
    back = runs.select("run", *_TEXT).join(root, _TEXT).select("run", *_TEXT, "n", "best")
    return rows.withColumn("run", _run()).join(back, ["run", *_TEXT])


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    fan_bits: int = FAN_BITS,
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    Texts are equal if they are identical without ASCII white space; null counts as empty.  Of
    equal texts the row with the most code points stays, then the smallest id; null ids come last,
    and of rows equal in all of this one stays.  A long text is one value of its row; only its digest
    is shuffled.  Ids may have any type with an order.  Empty tables give no rows; other columns of
    ``docs`` aren't read.
    """
    rows = staged(digests(docs, id_col, text_col), "digests")
    return _decided(rows, fan_bits).select(
        "id",
        F.col("best.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows that agree in id, text length and normalised text are one row: one of them stays.  Texts
    are shuffled once, and again only if there are such rows.
    """
    rows = staged(digests(docs, id_col, text_col), "digests")
    key = ["id", "digest", "points"]
    stay = (
        _decided(rows, FAN_BITS)
        .where(F.col("row") == F.col("best.row"))
        .select(*(F.col(c).alias(f"{P}{c}") for c in key))
    )
    again = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    own = docs.withColumn(f"{P}own", F.unhex(F.sha2(normalised(F.col(text_col)), 256)))
    match = (
        F.col(id_col).eqNullSafe(F.col(f"{P}id"))
        & (F.col(f"{P}own") == F.col(f"{P}digest"))
        & (F.coalesce(F.length(text_col), F.lit(0)) == F.col(f"{P}points"))
    )
    kept = own.join(stay, match, "left_semi")
    if again:
        kept = kept.dropDuplicates([id_col, f"{P}own"])
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
