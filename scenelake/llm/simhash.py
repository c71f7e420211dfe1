"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, components.

Fingerprint: XXH64 (seed 42) of every three-word shingle, repeats included; a bit is set where
more than half of the hashes have it.  A text below three words is one shingle of all its words;
a text without words has fingerprint zero.

Links: fingerprints at two or fewer differing bits.  64 bits are split into four blocks of 16;
two differing bits leave at least two blocks whole, so a linked pair meets in one of the six
tables keyed by two blocks.  A pair is kept only after its Hamming distance was computed.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.llm.common import P, staged
from scenelake.llm.components import components

SEED = 42
SHINGLE = 3
BITS = 64
#: For each byte value, its eight bits as eight byte-wide counters of one integer.
_SPREAD = np.array(
    [sum(((v >> b) & 1) << (8 * b) for b in range(8)) for v in range(256)], dtype=np.uint64
)
#: ASCII capitals to small letters, all other bytes unchanged.
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _majority(hashes: np.ndarray) -> int:
    """Bits that more than half of ``hashes`` (uint64) have."""
    counts = np.zeros(BITS, dtype=np.int64)
    spread = _SPREAD[hashes.astype("<u8").view(np.uint8).reshape(-1, 8)]
    for at in range(0, len(spread), 255):  # a byte counts up to 255
        part = spread[at : at + 255].sum(axis=0, dtype=np.uint64)
        counts += part.astype("<u8").view(np.uint8)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one UTF-8 text."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words])[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())]
    return _majority(np.array(hashes, dtype=np.uint64))


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE
) -> DataFrame:
    """(id, fp): the fingerprint of every whole text, null counting as empty, as a signed long."""

    def batches(it):
        for batch in it:
            texts = batch.column(1).cast(pa.binary())
            out = np.fromiter(
                (fingerprint(t.as_py() or b"", size) for t in texts), np.uint64, len(texts)
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out.view(np.int64))], names=["id", "fp"]
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(
        batches, "id long, fp long"
    )


BLOCKS = 4
#: Blocks with more members than this aren't compared pair by pair.
MAX_COMPARED = 256


def _block(fp: Column, i: int) -> Column:
    width = BITS // BLOCKS
    return F.shiftrightunsigned(fp, width * i).bitwiseAND(F.lit((1 << width) - 1))


def _keys(fp: Column) -> Column:
    """The six block keys of a fingerprint: table number and two whole blocks of 16 bits."""
    pairs = combinations(range(BLOCKS), 2)
    return F.array(
        *(
            F.struct(
                F.lit(n).alias("tab"),
                F.shiftleft(_block(fp, i), BITS // BLOCKS).bitwiseOR(_block(fp, j)).alias("key"),
            )
            for n, (i, j) in enumerate(pairs)
        )
    )


def links(classes: DataFrame, max_compared: int = MAX_COMPARED) -> DataFrame:
    """(u, v): links that join every two fingerprints at Hamming distance two or less.

    ``classes`` has one row per different ``fp`` with its representative ``rep``.  Members of a
    block are compared in a join and kept if their distance was verified.  A block of more than
    ``max_compared`` members would make too many pairs: there every member is filed under itself
    and its single-bit changes outside the shared blocks, and linked to the smallest member of
    each file.  Two members of one file are both one bit or less from its key, so they are two
    bits or less apart; and any two members at distance two or less share a file.  The result has
    the same components and grows in proportion to the members.
    """
    filed = classes.select("fp", "rep", F.explode(_keys(F.col("fp"))).alias("k")).select(
        "fp", "rep", "k.tab", "k.key"
    )
    sizes = filed.groupBy("tab", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = staged(filed.join(sizes, ["tab", "key"]), "blocks")
    few = met.where(F.col("n") <= max_compared)
    a = few.select("tab", "key", F.col("fp").alias("fa"), F.col("rep").alias("u"))
    b = few.select("tab", "key", F.col("fp").alias("fb"), F.col("rep").alias("v"))
    near = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= 2
    close = a.join(b, ["tab", "key"]).where((F.col("u") < F.col("v")) & near).select("u", "v")
    many = met.where(F.col("n") > max_compared)
    flips = F.array(
        F.lit(0).cast("long"),
        *(F.lit(1 << i if i < BITS - 1 else -(1 << i)).cast("long") for i in range(BITS)),
    )
    file = many.select("tab", "key", "rep", "fp", F.explode(flips).alias("f")).select(
        "tab", "key", "rep", F.col("fp").bitwiseXOR(F.col("f")).alias("near")
    )
    # a change inside the shared blocks leaves the block: such files hold one member only
    least = file.groupBy("tab", "key", "near").agg(F.min("rep").alias("v"))
    star = (
        file.join(least, ["tab", "key", "near"])
        .where("rep <> v")
        .select(F.col("rep").alias("u"), "v")
    )
    return close.union(star)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    max_compared: int = MAX_COMPARED,
) -> DataFrame:
    """(id, fp, component): each row's fingerprint and the smallest id reachable over links.

    Null and empty texts have fingerprint zero and link like any other; rows with a null id link
    to nothing and get a null component; repeated rows give repeated results; an empty table gives
    no rows.  Other columns of ``docs`` aren't read.
    """
    prints = staged(fingerprints(docs, id_col, text_col, size), "fingerprints")
    known = prints.where("id is not null")
    classes = staged(known.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    found = components(links(classes, max_compared))
    of_class = classes.join(found, F.col("rep") == F.col("node"), "left").select(
        F.col("fp").alias(f"{P}fp"), F.coalesce("label", "rep").alias(f"{P}c")
    )
    return prints.join(of_class, F.col("fp") == F.col(f"{P}fp"), "left").select(
        "id",
        "fp",
        F.when(F.col("id").isNotNull(), F.col(f"{P}c")).alias("component"),
    )


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` but for those whose component has a smaller id.

    Rows with a null id stay.  If an id is repeated, its rows go only if none of them is the
    smallest of its component.
    """
    found = near_duplicates(docs, id_col, text_col).where("id is not null")
    gone = found.groupBy("id").agg(F.max("component").alias("m"))
    gone = gone.where("m < id").select(F.col("id").alias(f"{P}gone"))
    return docs.join(gone, F.col(id_col) == F.col(f"{P}gone"), "left_anti")
