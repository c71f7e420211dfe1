"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

Equal vectors form one class, so copies cost one index entry.  Coarse centroids and the codebooks
of residual parts are fitted on a bounded sample; every class is filed under its nearest centroid
with one byte per part.  A query visits its nearest lists.  The squared distance of a query to a
coded vector is that to the list's centroid, plus a constant of the code, less twice the sum of the
parts' products with the query; those products are the query's one table, whatever lists it visits.
The best candidates by that estimate are reranked by the exact distance of the original vectors.

Lists lie on shards of bounded size: small ones share a shard, large ones are dealt over several.  A
query's vector goes once to every shard that it visits.  Each dimension has an index of its own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenelake.llm.common import P, staged

K = 10
#: Vectors that centroids and codebooks are fitted on, at most by expectation.
TRAIN = 20_000
#: Parts of a vector, each a byte of its code; codewords of a part.
PARTS = 16
CODEWORDS = 256
#: Lists of the index at most.
MAX_LISTS = 4096
#: A query visits as many lists as hold this share of the nearest vectors of trial queries, found by
#: brute force in the sample; and so many trial queries.
TARGET = 0.95
TRIALS = 256
#: Candidates of a query that are reranked, up to so many classes; beyond, they grow with the fourth root.
RERANK = 200
RERANK_CLASSES = 2_000
#: Index entries of a shard.
SLICE = 50_000
_ROUNDS = 10


def depth(n: int) -> int:
    """Candidates of a query that are reranked if there are ``n`` classes."""
    return math.ceil(RERANK * max(1.0, n / RERANK_CLASSES) ** 0.25)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1), 0)


def _nearest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    step = max(1, 8_000_000 // max(1, len(b)))
    parts = [_squares(a[i : i + step], b).argmin(1) for i in range(0, len(a), step)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def kmeans(points: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """At most ``k`` centroids by Lloyd's rounds from a random start; empty ones are drawn anew."""
    random = np.random.default_rng(seed)
    k = min(k, len(points))
    centroids = points[random.choice(len(points), k, replace=False)]
    for _ in range(_ROUNDS):
        at = _nearest(points, centroids)
        counts = np.bincount(at, minlength=k)
        sums = np.stack([np.bincount(at, points[:, d], minlength=k) for d in range(points.shape[1])], 1)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
        if (empty := np.flatnonzero(counts == 0)).size:
            centroids[empty] = points[random.choice(len(points), len(empty))]
    return centroids


@dataclass(frozen=True)
class Codebook:
    """Coarse centroids and, for each part of the residuals, its codewords."""

    centroids: np.ndarray
    edges: list[int]
    words: list[np.ndarray]

    @classmethod
    def fit(cls, points: np.ndarray, lists: int, parts: int, codewords: int) -> Codebook:
        dim = points.shape[1]
        centroids = kmeans(points, lists)
        residual = points - centroids[_nearest(points, centroids)]
        parts = min(parts, dim)
        edges = [dim * i // parts for i in range(parts + 1)]
        words = [kmeans(residual[:, a:b], codewords) for a, b in zip(edges, edges[1:])]
        return cls(centroids, edges, words)

    def encode(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, codes) of each row."""
        at = _nearest(points, self.centroids)
        residual = points - self.centroids[at]
        codes = [_nearest(residual[:, a:b], w) for a, b, w in zip(self.edges, self.edges[1:], self.words)]
        return at, np.stack(codes, 1).astype(np.uint8)

    def probes(self, points: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest lists of each row."""
        d = _squares(points, self.centroids)
        n = min(n, d.shape[1])
        return np.argpartition(d, n - 1, axis=1)[:, :n]

    def needed(self, points: np.ndarray, k: int, target: float) -> int:
        """Lists to visit so that ``target`` of the true neighbours in the sample are in them."""
        trials = points[:: max(1, len(points) // TRIALS)]
        own = _nearest(points, self.centroids)
        ranks = _squares(trials, self.centroids).argsort(1).argsort(1)
        near = _squares(trials, points).argsort(1)[:, 1 : k + 1]
        if not near.size:
            return len(self.centroids)
        found = np.sort(ranks[np.arange(len(trials))[:, None], own[near]].ravel())
        return int(found[min(len(found) - 1, math.ceil(target * len(found)) - 1)]) + 1

    def constants(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What the query has no part in: |codeword|**2 + 2 * centroid * codeword over all parts."""
        out = np.zeros(len(codes))
        for j, (a, b, w) in enumerate(zip(self.edges, self.edges[1:], self.words)):
            own = w[codes[:, j]]
            out += ((own + 2 * self.centroids[lists, a:b]) * own).sum(1)
        return out

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(query, part, codeword): minus twice the products of a query's parts and the codewords."""
        out = np.zeros((len(queries), len(self.words), max(len(w) for w in self.words)))
        for j, (a, b, w) in enumerate(zip(self.edges, self.edges[1:], self.words)):
            out[:, j, : len(w)] = -2 * queries[:, a:b] @ w.T
        return out


def shards(held: dict[int, int], lists: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, number) of shards of each list, for lists with ``held`` entries: a list above ``size`` has
    shards of its own, others share one as long as it holds no more than ``size``."""
    first, number, at, filled = np.zeros(lists, np.int64), np.ones(lists, np.int64), 0, 0
    for i in range(lists):
        n = held.get(i, 0)
        if filled and filled + n > size:
            at, filled = at + 1, 0
        first[i], number[i] = at, max(1, math.ceil(n / size))
        if n > size:
            at, filled = at + number[i], 0
        else:
            filled += n
    return first, number


def _valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, dim): rows that take part, in double precision."""
    return (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        .where(
            F.col("id").isNotNull()
            & F.col("vec").isNotNull()
            & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists("vec", lambda x: x != 0)
        )
        .withColumn("dim", F.size("vec"))
    )


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of doubles."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def search(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = K,
    train: int = TRAIN,
    rerank: int | None = None,
    target: float = TARGET,
    slice_rows: int = SLICE,
) -> DataFrame:
    """(query, rank, id, score): for each row that ``is_query`` holds for, its ``k`` nearest others.

    ``is_query`` is a condition on the column ``id``.  ``score`` is the Euclidean distance of the
    original vectors in double precision; ties go to the smaller id.  Null, zero and non-finite
    vectors and rows without an id take no part; vectors of different dimensions have no distance,
    so each dimension is searched by itself.  Of rows with equal id and vector one counts.  Fewer than
    ``k`` candidates are returned all; an empty table gives no rows; other columns aren't read.
    Very long vectors count like others.  ``rerank`` is :func:`depth` of the classes if not given.
    """
    rows = staged(_valid(vectors, id_col, vec_col).distinct(), "vectors")
    dims = [r["dim"] for r in rows.select("dim").distinct().orderBy("dim").collect()]
    found = [
        _search(rows.where(F.col("dim") == d).select("id", "vec"), is_query, k, train, rerank, target, slice_rows)
        for d in dims
    ]
    empty = vectors.sparkSession.createDataFrame([], "query long, rank int, id long, score double")
    return reduce(DataFrame.unionByName, found) if found else empty


def _search(
    rows: DataFrame, is_query: Column, k: int, train: int, rerank: int | None, target: float, slice_rows: int
) -> DataFrame:
    """:func:`search` among the vectors of one dimension."""
    spark = rows.sparkSession
    classes = staged(
        rows.groupBy("vec").agg(F.min("id").alias("rep"), F.max(is_query).alias("asked")), "vector-classes"
    )
    n = classes.count()
    rerank = depth(n) if rerank is None else rerank
    lists = min(MAX_LISTS, max(1, 1 << round(math.log2(math.sqrt(n) / 2 + 1))))
    share = F.pmod(F.xxhash64(F.lit(2), "rep"), F.lit(1 << 30)) / float(1 << 30)
    sample = classes.where(share < train / n).select("rep", "vec").toPandas().sort_values("rep")
    if not len(sample):
        sample = classes.select("rep", "vec").orderBy("rep").limit(1).toPandas()
    points = np.stack(sample["vec"].to_numpy())
    book = Codebook.fit(points, lists, PARTS, CODEWORDS)
    shared = spark.sparkContext.broadcast(book)  # bounded by the parameters above
    lists = len(book.centroids)

    def filed(it):
        for batch in it:
            if batch.num_rows:
                at, codes = shared.value.encode(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(at.astype(np.int32)),
                        batch.column(0),
                        pa.array([c.tobytes() for c in codes], pa.binary()),
                    ],
                    names=["list", "rep", "code"],
                )

    index = staged(classes.select("rep", "vec").mapInArrow(filed, "list int, rep long, code binary"), "index")
    held = {r["list"]: r["n"] for r in index.groupBy("list").agg(F.count("*").alias("n")).collect()}
    first, number = shards(held, lists, slice_rows)
    probes = book.needed(points, k, target)

    def asked(it):
        for batch in it:
            if batch.num_rows:
                at = shared.value.probes(_matrix(batch.column(1)), probes)
                out = {"shard": [], "who": [], "lists": []}
                for who, own in enumerate(np.sort(at, axis=1)):
                    shard = np.repeat(first[own], number[own])
                    shard += np.concatenate([np.arange(m) for m in number[own]])
                    own = np.repeat(own, number[own])
                    edges = np.flatnonzero(np.diff(shard, prepend=-1))  # shards rise with lists
                    out["shard"].extend(shard[edges].tolist())
                    out["who"].extend([who] * len(edges))
                    out["lists"].extend(x.astype("<i4").tobytes() for x in np.split(own, edges[1:]))
                who = pa.array(out["who"], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(out["shard"], pa.int64()),
                        batch.column(0).take(who),
                        pa.array(out["lists"], pa.binary()),
                        batch.column(1).take(who),
                    ],
                    names=["shard", "query", "lists", "vec"],
                )

    queries = classes.where("asked").select("rep", "vec")
    visits = queries.mapInArrow(asked, "shard long, query long, lists binary, vec array<double>")
    place = F.array(*(F.struct(F.lit(int(a)).alias("first"), F.lit(int(b)).alias("number")) for a, b in zip(first, number)))
    own = F.element_at(place, F.col("list") + 1)  # lists are bounded by MAX_LISTS
    dealt = index.select(
        (own["first"] + F.pmod(F.xxhash64("rep"), own["number"])).cast("long").alias("shard"), "list", "rep", "code"
    )

    def scored(key, ours, theirs):
        out_q, out_c, out_d = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if theirs.num_rows and ours.num_rows:
            book = shared.value
            lists, reps = theirs["list"].to_numpy(), theirs["rep"].to_numpy()
            codes = np.frombuffer(b"".join(theirs["code"].to_pylist()), np.uint8).reshape(len(reps), -1)
            order = np.lexsort((reps, lists))
            lists, reps, codes = lists[order], reps[order], np.ascontiguousarray(codes[order].T)
            constants = book.constants(lists, codes.T)
            known, starts = np.unique(lists, return_index=True)
            span = {int(i): (a, b) for i, a, b in zip(known, starts, [*starts[1:], len(lists)])}
            for block in ours.to_batches(max_chunksize=256):
                points = _matrix(block.column("vec"))
                tables = book.tables(points)
                for q, own, point, table in zip(
                    block.column("query").to_pylist(), block.column("lists").to_pylist(), points, tables
                ):
                    visited = [(i, *span[i]) for i in np.frombuffer(own, "<i4").tolist() if i in span]
                    if not visited:
                        continue
                    at = np.concatenate([np.arange(a, b) for _, a, b in visited])
                    centres = ((point - book.centroids[[i for i, _, _ in visited]]) ** 2).sum(1)
                    d = constants[at] + np.repeat(centres, [b - a for _, a, b in visited])
                    for j, part in enumerate(table):
                        d += part[codes[j, at]]
                    best = np.argsort(d, kind="stable")[:rerank]
                    out_q.append(np.full(len(best), q))
                    out_c.append(reps[at[best]])
                    out_d.append(d[best])
        return pa.table(
            {
                "query": pa.array(np.concatenate(out_q).astype(np.int64)),
                "rep": pa.array(np.concatenate(out_c).astype(np.int64)),
                "estimate": pa.array(np.concatenate(out_d)),
            }
        )

    found = (
        visits.groupBy("shard")
        .cogroup(dealt.groupBy("shard"))
        .applyInArrow(scored, "query long, rep long, estimate double")
    )
    near = Window.partitionBy("query").orderBy("estimate", "rep")
    chosen = found.withColumn("r", F.row_number().over(near)).where(F.col("r") <= rerank).select("query", "rep")
    chosen = chosen.union(queries.select(F.col("rep").alias("query"), "rep")).distinct()
    exact = (
        chosen.join(classes.select("rep", "vec"), "rep")
        .join(queries.select(F.col("rep").alias("query"), F.col("vec").alias("own")), "query")
        .select("query", "rep", distance(F.col("own"), F.col("vec")).alias("score"))
    )
    # k + 1 nearest classes hold the k nearest rows: each has a row, and a query skips only its own
    top = Window.partitionBy("query").orderBy("score", "rep")
    exact = exact.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1)
    few = Window.partitionBy("vec").orderBy("id")
    members = (
        rows.withColumn("r", F.row_number().over(few))
        .where(F.col("r") <= k + 1)
        .join(classes.select("vec", "rep"), "vec")
        .select("rep", "id")
    )
    ranked = Window.partitionBy("query").orderBy("score", "id")
    short = (
        exact.select("query", "rep", "score")
        .join(members, "rep")
        .withColumn("r", F.row_number().over(ranked))
        .where(F.col("r") <= k + 1)
        .groupBy("query")
        .agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("near"))  # k + 1 at most
    )
    asking = rows.where(is_query).join(classes.select("vec", "rep"), "vec").select("id", "rep")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col(f"{P}q")), 1, k)
    return (
        asking.select(F.col("id").alias(f"{P}q"), F.col("rep").alias("query"))
        .join(short, "query")
        .select(F.col(f"{P}q").alias("query"), F.posexplode(others).alias("pos", "x"))
        .select("query", (F.col("pos") + 1).cast("int").alias("rank"), "x.id", "x.score")
    )
