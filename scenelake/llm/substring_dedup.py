"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark.

Rows are dealt evenly into chunks of bounded size, whatever their ids.  A window's hash is a polynomial
of its words modulo the prime 2**61 - 1, rolled over a whole chunk at once.  Three steps follow:

1. Count: every chunk sends its different hashes, once each and in order, to buckets, ranges of hashes;
   a bucket tells the chunks which of their hashes others have too.
2. Claim: of those windows a chunk sends hash, a second hash of the words themselves and the smallest
   document.  A bucket finds the smallest document of all and tells it to the chunks that don't hold it.
3. Remove: a chunk marks the windows that start in a smaller document, elsewhere or here, and merges
   them into maximal removal intervals.

A passage that many documents share costs one entry for each chunk, in whatever number of copies.  Only
as many bits of a hash are sent as the number of windows asks for, in byte planes that compress well.
Windows of one Rabin-Karp hash count as equal only if the hashes of their words, which have nothing to
do with the polynomial, agree as well, inside a chunk and between chunks: some 100 bits and more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenelake.llm.common import P, shuffle_partitions, total_chars

WINDOW = 50
#: The modulus, a prime, and the base of the polynomial.
PRIME = (1 << 61) - 1
_BASE = 0x1E3779B97F4A7C15
#: Characters of text in a chunk, and windows in a bucket, by expectation.
CHUNK_CHARS = 4_000_000
BUCKET_WINDOWS = 500_000
#: Bits of the Rabin-Karp hash beyond those that number the windows: one window in 2**12 is claimed in vain.
SPARE_BITS = 12
#: Words whose hashes a worker remembers.
_REMEMBERED = 300_000


class _WordHashes(dict):
    """Words to numbers up to the modulus; forgets all when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word) & PRIME
        return value


_HASHES = _WordHashes()
_POWERS: dict[int, np.ndarray] = {}
_M, _LOW31, _LOW30 = np.uint64(PRIME), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime, in 0 .. PRIME - 1."""
    x = (x & _M) + (x >> np.uint64(61))
    return np.where(x >= _M, x - _M, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers up to it, by halves of 30 and 31 bits."""
    a1, a0, b1, b0 = a >> np.uint64(31), a & _LOW31, b >> np.uint64(31), b & _LOW31
    middle = a1 * b0 + a0 * b1
    high = np.uint64(2) * a1 * b1 + (middle >> np.uint64(30)) + ((middle & _LOW30) << np.uint64(31))
    return _reduced(high + a0 * b0)


def _powers(base: int, n: int) -> np.ndarray:
    """base**i modulo the prime for i below ``n`` at least, by doubling."""
    known = _POWERS.get(base, np.ones(1, np.uint64))
    while len(known) < n:
        step = np.uint64(pow(base, len(known), PRIME))
        known = np.concatenate((known, _times(known, step)))
    _POWERS[base] = known
    return known


def _rolled(words: np.ndarray, window: int) -> np.ndarray:
    """The polynomial hash of every window: sum of word * base**position, shifted to position zero."""
    n = len(words)
    terms = _times(words, _powers(_BASE, n)[:n])
    # prefix sums of both halves are exact in 64 bits up to 2**31 words
    low = np.cumsum(terms & np.uint64(0xFFFFFFFF))
    high = np.cumsum(terms >> np.uint64(32))
    turned = ((high & np.uint64((1 << 29) - 1)) << np.uint64(32)) + (high >> np.uint64(29))
    sums = np.concatenate((np.zeros(1, np.uint64), _reduced(_reduced(turned) + low)))
    parts = _reduced(sums[window:] + (_M - sums[:-window]))
    return _times(parts, _powers(pow(_BASE, -1, PRIME), n)[: len(parts)])


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The buckets are ``buckets`` equal ranges of hashes."""
    return (((hashes >> np.uint64(29)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


@dataclass(frozen=True)
class _Rules:
    window: int
    buckets: int
    hash_bits: int


class _Chunk:
    """The windows of one chunk of documents, document by document: hash, row, first word."""

    def __init__(self, ids: list, texts: pa.ChunkedArray, rules: _Rules):
        self.ids, self.window = ids, rules.window
        self.words = list(_words(texts))
        sizes = np.array([len(w) for w in self.words], np.int64)
        values = np.concatenate([np.empty(0, np.uint64), *map(word_hashes, self.words)])
        known = np.array([i is not None for i in ids], bool)
        self.counts = np.where(known, np.maximum(sizes - rules.window + 1, 0), 0).astype(np.int64)
        self.rows = np.repeat(np.arange(len(ids)), self.counts)
        ends = np.cumsum(self.counts)
        self.starts = np.arange(len(self.rows)) - np.repeat(ends - self.counts, self.counts)
        first = np.cumsum(sizes) - sizes
        rolled = _rolled(values, rules.window) if len(values) >= rules.window else np.empty(0, np.uint64)
        kept_bits = np.uint64(PRIME >> (61 - rules.hash_bits) << (61 - rules.hash_bits))
        self.hashes = rolled[first[self.rows] + self.starts] & kept_bits
        self.docs = np.array([0 if i is None else i for i in ids], np.int64)[self.rows]

    def word_digests(self, which: np.ndarray) -> np.ndarray:
        """A hash of the words of each window of ``which``, ascending places among the windows."""
        out = np.empty(len(which), np.uint64)
        rows = self.rows[which]
        bounds = np.flatnonzero(np.diff(rows, prepend=-1))
        for a, b in zip(bounds, [*bounds[1:], len(rows)]):
            words = self.words[rows[a]]
            joined = b" ".join(words)
            at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)))
            starts = self.starts[which[a:b]]
            spans = zip(at[starts].tolist(), (at[starts + self.window] - 1).tolist())
            out[a:b] = [xxhash.xxh3_64_intdigest(joined[x:y]) for x, y in spans]
        return out


def _words(texts: pa.ChunkedArray) -> Iterator[list[bytes]]:
    """Words of each text between ASCII white space; null has none."""
    for text in texts.cast(pa.large_binary()):
        yield (text.as_py() or b"").split()


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of 64 bits byte plane by byte plane: planes of sorted or small numbers compress well."""
    return b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)


def _unpacked(data: list[bytes], columns: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of all packs one after the other, and the number of rows of each pack."""
    sizes = np.array([len(d) // (8 * columns) for d in data], np.int64)
    out = []
    for c in range(columns):
        own = [d[8 * n * c : 8 * n * (c + 1)] for d, n in zip(data, sizes.tolist())]
        flat = [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(np.uint64).ravel() for x in own]
        out.append(np.concatenate([np.empty(0, np.uint64), *flat]))
    return out, sizes


_SENT = "bucket int, chunk int, data binary"
_CHUNK, _ID, _TEXT = f"{P}chunk", f"{P}id", f"{P}text"


def _blocks(buckets: np.ndarray, chunks: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """One row for each run of equal (bucket, chunk)."""
    new = np.ones(len(buckets), bool)
    new[1:] = (buckets[1:] != buckets[:-1]) | (chunks[1:] != chunks[:-1])
    edges = np.append(np.flatnonzero(new), len(buckets)) if len(buckets) else np.zeros(1, np.int64)
    data = [_packed(*(c[a:b] for c in columns)) for a, b in zip(edges, edges[1:])]
    return pa.table(
        {
            "bucket": pa.array(buckets[edges[:-1]].astype(np.int32)),
            "chunk": pa.array(chunks[edges[:-1]].astype(np.int32)),
            "data": pa.array(data, pa.binary()),
        }
    )


def _first_ids(*keys_and_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of (hash, digest, id), and for each place in that order the smallest id of its pair."""
    hashes, digests, ids = keys_and_ids
    order = np.lexsort((ids, digests, hashes))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(hashes[order]) != 0) | (np.diff(digests[order]) != 0)
    return order, ids[order][new][np.cumsum(new) - 1] if len(order) else ids


def _distinct(values: np.ndarray) -> np.ndarray:
    """The different numbers in order; sorting is faster here than the library's hash table."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


def _is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``values`` are among ``known``, sorted numbers."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _repeated(sorted_values: np.ndarray) -> np.ndarray:
    """Which of sorted numbers have an equal beside them."""
    same = np.zeros(len(sorted_values) + 1, bool)
    same[1:-1] = sorted_values[1:] == sorted_values[:-1]
    return same[1:] | same[:-1]


def _dealt(docs: DataFrame, id_col: str, text_col: str, chunks: int, carried: list[str]) -> DataFrame:
    """Chunk, id and text of each row, and the ``carried`` columns; rows of one id go anywhere."""
    row = F.xxhash64(F.monotonically_increasing_id())
    return docs.select(
        F.pmod(row, F.lit(chunks)).cast("int").alias(_CHUNK),
        F.col(id_col).cast("long").alias(_ID),
        F.col(text_col).alias(_TEXT),
        *(F.col(f"`{c}`") for c in carried),
    )


def _counted(rows: DataFrame, rules: _Rules) -> DataFrame:
    """(bucket, chunk, data): for each chunk its window hashes that other chunks have too."""

    def send(key, table):
        own = _distinct(_Chunk(table[_ID].to_pylist(), table[_TEXT], rules).hashes)
        return _blocks(bucket_of(own, rules.buckets), np.full(len(own), key[0].as_py()), own)

    def meet(key, table):
        (hashes,), sizes = _unpacked(table["data"].to_pylist(), 1)
        owner = np.repeat(table["chunk"].to_numpy().astype(np.int64), sizes)
        order = np.argsort(hashes, kind="stable")
        shared = order[_repeated(hashes[order])]
        shared = shared[np.argsort(owner[shared], kind="stable")]
        return _blocks(np.full(len(shared), key[0].as_py()), owner[shared], hashes[shared])

    return rows.groupBy(_CHUNK).applyInArrow(send, _SENT).groupBy("bucket").applyInArrow(meet, _SENT)


def _settled(rows: DataFrame, counted: DataFrame, rules: _Rules) -> DataFrame:
    """(bucket, chunk, data): hash, digest and smallest document of windows that start in a smaller
    document than all of the chunk's."""

    def claim(key, ours, theirs):
        if not theirs.num_rows or not ours.num_rows:
            return _blocks(*[np.empty(0, np.int64)] * 2, *[np.empty(0, np.uint64)] * 3)
        (shared,), _ = _unpacked(theirs["data"].to_pylist(), 1)
        own = _Chunk(ours[_ID].to_pylist(), ours[_TEXT], rules)
        which = np.flatnonzero(_is_in(own.hashes, np.sort(shared)))
        hashes, digests, docs = own.hashes[which], own.word_digests(which), own.docs[which]
        order, first = _first_ids(hashes, digests, docs)
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(hashes[order]) != 0) | (np.diff(digests[order]) != 0)
        hashes, digests, first = hashes[order][new], digests[order][new], first[new]
        chunk = np.full(len(hashes), key[0].as_py())
        return _blocks(bucket_of(hashes, rules.buckets), chunk, hashes, digests, first)

    def settle(key, table):
        (hashes, digests, ids), sizes = _unpacked(table["data"].to_pylist(), 3)
        ids = ids.view(np.int64)
        owner = np.repeat(table["chunk"].to_numpy().astype(np.int64), sizes)
        order, first = _first_ids(hashes, digests, ids)
        later = first < ids[order]
        order, first = order[later], first[later]
        by_owner = np.argsort(owner[order], kind="stable")
        order, first = order[by_owner], first[by_owner]
        bucket = np.full(len(order), key[0].as_py())
        return _blocks(bucket, owner[order], hashes[order], digests[order], first)

    claims = rows.groupBy(_CHUNK).cogroup(counted.groupBy("chunk")).applyInArrow(claim, _SENT)
    return claims.groupBy("bucket").applyInArrow(settle, _SENT)


def _marked(own: _Chunk, told: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Windows to remove: their words also start in a smaller document, told of or in this chunk."""
    hashes, digests, ids = told
    ids = ids.view(np.int64)
    ordered = np.sort(own.hashes)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    which = np.flatnonzero(_is_in(own.hashes, again) | _is_in(own.hashes, np.sort(hashes)))
    n = len(which)
    docs = np.concatenate((own.docs[which], ids))
    order, first = _first_ids(
        np.concatenate((own.hashes[which], hashes)), np.concatenate((own.word_digests(which), digests)), docs
    )
    later = np.zeros(len(order), bool)
    later[order] = first < docs[order]
    out = np.zeros(len(own.hashes), bool)
    out[which] = later[:n]
    return out


def covered(starts: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Which of ``n_words`` words lie in a marked window: the windows merged into intervals."""
    edge = np.zeros(n_words + 1, np.int64)
    at = np.flatnonzero(starts)
    edge[at] += 1
    edge[at + window] -= 1  # different starts have different ends
    return np.cumsum(edge[:-1]) > 0


def _removed(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    window: int,
    chunk_chars: int,
    bucket_windows: int,
    hash_bits: int | None,
    carried: list[str],
) -> DataFrame:
    """The carried columns, then id, n_words, n_removed, kept and spans with scratch names."""
    spark = docs.sparkSession
    chars = total_chars(docs, text_col)
    chunks = max(shuffle_partitions(spark), math.ceil(chars / chunk_chars))
    buckets = max(4 * shuffle_partitions(spark), math.ceil(chars / 6 / bucket_windows))
    if hash_bits is None:
        hash_bits = min(61, max(32, math.ceil(math.log2(chars / 6 + 1)) + SPARE_BITS))
    rules = _Rules(window, buckets, hash_bits)
    rows = _dealt(docs, id_col, text_col, chunks, carried)
    told = _settled(rows, _counted(rows, rules), rules)
    arrow = [
        ("id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("kept", pa.string()),
        ("spans", pa.list_(pa.list_(pa.int64()))),
    ]

    def remove(key, ours, theirs):
        ids = ours[_ID].to_pylist()
        own = _Chunk(ids, ours[_TEXT], rules)
        marks = _marked(own, tuple(_unpacked(theirs["data"].to_pylist(), 3)[0]))
        out = {k: [] for k, _ in arrow}
        at = 0
        for i, w, n in zip(ids, own.words, own.counts.tolist()):
            gone = covered(marks[at : at + n], len(w), window) if n else np.zeros(len(w), bool)
            at += n
            edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
            out["id"].append(i)
            out["n_words"].append(len(w))
            out["n_removed"].append(int(gone.sum()))
            out["spans"].append(edges.reshape(-1, 2).tolist())
            if len(edges):
                left = [0, *edges.tolist(), len(w)]
                w = [x for a, b in zip(left[::2], left[1::2]) for x in w[a:b]]
            out["kept"].append(b" ".join(w).decode())
        new = {f"{P}{k}": pa.array(out[k], kind) for k, kind in arrow}
        return pa.table({c: ours[c] for c in carried} | new)

    schema = T.StructType(
        [docs.schema[c] for c in carried]
        + [
            T.StructField(f"{P}id", T.LongType()),
            T.StructField(f"{P}n_words", T.LongType()),
            T.StructField(f"{P}n_removed", T.LongType()),
            T.StructField(f"{P}kept", T.StringType()),
            T.StructField(f"{P}spans", T.ArrayType(T.ArrayType(T.LongType()))),
        ]
    )
    return rows.groupBy(_CHUNK).cogroup(told.groupBy("chunk")).applyInArrow(remove, schema)


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    chunk_chars: int = CHUNK_CHARS,
    bucket_windows: int = BUCKET_WINDOWS,
    hash_bits: int | None = None,
) -> DataFrame:
    """(id, n_words, n_removed, kept, spans) for every row of ``docs``.

    A word is removed if a window that covers it has the same words as a window that starts in a
    document with a smaller id; all windows are judged on the input.  ``kept`` joins the words
    left by one space; ``spans`` lists the removal intervals as [first word, end).  Null texts
    have no words and give the empty string.  Rows with a null id lose nothing and take nothing
    from others; rows of equal id don't affect each other; an empty table gives no rows; other
    columns aren't read.  A long text is held whole, with its words, by the task of its chunk.

    ``hash_bits`` of the Rabin-Karp hash are used, by default as many as the input's size asks for;
    fewer cost more claims and give the same result.
    """
    found = _removed(docs, id_col, text_col, window, chunk_chars, bucket_windows, hash_bits, [])
    return found.select(*(F.col(f"{P}{c}").alias(c) for c in ("id", "n_words", "n_removed", "kept", "spans")))


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """``docs`` with all its rows and columns, and with the words left as its text.

    Texts that lose nothing stay as they are, null ones too; texts that lose every word become
    empty.  The rules are those of :func:`remove_repeats`.
    """
    found = _removed(docs, id_col, text_col, window, CHUNK_CHARS, BUCKET_WINDOWS, None, docs.columns)
    new = F.when(F.col(f"{P}n_removed") > 0, F.col(f"{P}kept")).otherwise(F.col(text_col))
    return found.select(*(new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
