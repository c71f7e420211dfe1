"""Packing: concatenate and cut.

First pass: every input partition encodes its documents, gives each the token count before it in
the partition, and the partitions' totals are summed to global offsets.  Second pass: the stream
of all tokens is cut into windows of fixed length, and every document becomes one boundary record
for each window that it touches.  Only the last window can be short.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenelake.llm.bpe import encoder, slices, utf8
from scenelake.llm.common import staged

LENGTH = 1024
#: Id after the last token of every document.
END_ID = 0


def _tokens(docs: DataFrame, path: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """(part, at, id, n, ids): packed ids with the partition and the tokens before it there."""
    end = np.array([end_id], "<u4").tobytes()

    def batches(it):
        own, part, at = encoder(path), TaskContext.get().partitionId(), 0
        for batch in it:
            for rows in slices(batch):
                ids = [i + end for i in own.encode_whole(utf8(rows.column(1)))]
                n = np.array([len(i) // 4 for i in ids], np.int64)
                ends = at + np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ids), part, np.int32)),
                        pa.array(ends - n),
                        rows.column(0),
                        pa.array(n),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["part", "at", "id", "n", "ids"],
                )
                at = int(ends[-1])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(
        batches, "part int, at long, id long, n long, ids binary"
    )


def pack(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    end_id: int = END_ID,
) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence, offset): one row per piece of a document.

    ``ids`` are the piece's tokens as little-endian unsigned 32-bit integers.  Null and empty texts
    are the end id alone; repeated rows are packed each; an empty table gives no rows; other
    columns aren't read.  Encoded tokens are written once, so that offsets and pieces agree even
    if an executor is lost.
    """
    tokens = staged(_tokens(docs, path, id_col, text_col, end_id), "tokens", "zstd")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))  # a row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = tokens.join(F.broadcast(bases), "part").withColumn("g", F.col("base") + F.col("at"))
    g, n = F.col("g"), F.col("n")

    def piece(s):
        begin = F.greatest(s * length, g)
        size = F.least((s + 1) * length, g + n) - begin
        return F.struct(
            (begin - g).alias("start"),
            size.alias("length"),
            F.substr("ids", ((begin - g) * 4 + 1).cast("int"), (size * 4).cast("int")).alias("ids"),
            s.alias("sequence"),
            (begin - s * length).alias("offset"),
        )

    def window(at):
        return F.call_function("div", at, F.lit(length))

    pieces = F.transform(F.sequence(window(g), window(g + n - 1)), piece)
    return placed.select("id", F.col("n").alias("doc_tokens"), F.explode(pieces).alias("p")).select(
        "id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence", "p.offset"
    )
