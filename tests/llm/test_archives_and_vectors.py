"""ZIP and WARC round trips, and nearest neighbours against brute force."""

import hashlib
import io
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenelake.llm import warc, zip_archive
from scenelake.llm.ann import Codebook, depth, search, shards


class Bytes:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]


def wide_zip(name, body):
    """One stored member whose sizes and offset are all in ZIP64 fields."""
    wide = 0xFFFFFFFF
    extra = struct.pack("<HHQQ", 1, 16, len(body), len(body))
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, wide, wide, len(name), len(extra)) + name + extra
    extra = struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, wide, wide, len(name), len(extra), 0, 0, 0, 0, wide) + name + extra
    at = len(local) + len(body)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, at + len(central), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, wide, wide, 7) + b"comment"
    return local + body + central + end64 + locator + end


def test_zip64_directory():
    file = Bytes(wide_zip(b"archive/x", b"hello"))
    (m,) = zip_archive.members(file)
    at, n = zip_archive.stored_range(file, m)
    assert (m.name, file.read_at(n, at)) == ("archive/x", b"hello")


def test_zip_of_the_library_and_broken_ones():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", b"x" * 10)
        z.writestr("b/é", b"yy", zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 in a comment"
    file = Bytes(out.getvalue())
    a, b = zip_archive.members(file)
    at, n = zip_archive.stored_range(file, a)
    assert file.read_at(n, at) == b"x" * 10 and b.name == "b/é"
    with pytest.raises(zip_archive.ZipError):
        zip_archive.stored_range(file, b)
    with pytest.raises(zip_archive.ZipError):
        zip_archive.members(Bytes(b"no archive"))


def test_warc_round_trip(spark):
    big = "<p>é" + "x" * 200
    rows = [(5, "http://a/\n", big), (2, None, big), (9, "u", big), (1, "u", "short"), (3, "u", "short"), (4, "u", None), (None, "u", big), (2, None, big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    packages = warc.write(pages, package_bytes=300)
    got = warc.read(packages).collect()
    assert packages.agg(F.sum("n_records")).first()[0] == len(rows) == len(got)
    for r in got:
        html = next(h or "" for i, _, h in rows if i == r.id)
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), hashlib.sha256(html.encode()).hexdigest())
        revisit = r.id in (5, 9)
        assert (r.record_type, r.refers_to) == (("revisit", 2) if revisit else ("response", None))
        assert r.payload == (None if revisit else html.encode())
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_search_is_exact_with_all_lists(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(400, 8)).round(2)
    points[100:200] = points[0]  # a hot vector
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    rows += [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0] * 3), (None, [1.0] * 8), (904, [None] + [1.0] * 7), (5, rows[5][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rep", F.lit("x"))
    got = search(vectors, F.col("id") % 20 == 0, target=1.0, rerank=400, slice_rows=30).collect()
    for q in range(0, 400, 20):
        d = np.sqrt(((points - points[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(400), d))[:10]
        mine = sorted((r.rank, r.id, r.score) for r in got if r.query == q)
        assert [m[1] for m in mine] == want.tolist()
        assert np.allclose([m[2] for m in mine], d[want], atol=1e-12)
    assert len(got) == 200 and search(vectors.limit(0), F.col("id") % 20 == 0).count() == 0
    few = search(vectors.where("vec_id in (1, 20)"), F.col("id") % 20 == 0).collect()
    assert [(r.query, r.rank, r.id) for r in few] == [(20, 1, 1)]


def test_every_dimension_is_searched(spark):
    rng = np.random.default_rng(8)
    points = {i: rng.normal(size=(3, 8, 700)[i % 3]) for i in range(120)}
    vectors = spark.createDataFrame([(i, p.tolist()) for i, p in points.items()], "vec_id long, embedding array<double>")
    got = search(vectors, F.col("id") % 20 == 0, target=1.0, rerank=100).collect()
    for q in range(0, 120, 20):
        d = {i: float(np.sqrt(((p - points[q]) ** 2).sum())) for i, p in points.items() if i != q and len(p) == len(points[q])}
        want = sorted(d, key=lambda i: (d[i], i))[:10]
        assert [r.id for r in sorted(got) if r.query == q] == want
    assert len(got) == 60


def test_estimates_are_distances_to_coded_vectors():
    rng = np.random.default_rng(9)
    points = rng.normal(size=(500, 12))
    book = Codebook.fit(points, 8, 4, 16)
    lists, codes = book.encode(points)
    coded = book.centroids[lists] + np.concatenate([w[codes[:, j]] for j, w in enumerate(book.words)], 1)
    for q, table in zip(points[:5], book.tables(points[:5])):
        d = ((q - book.centroids[lists]) ** 2).sum(1) + book.constants(lists, codes)
        d += sum(part[codes[:, j]] for j, part in enumerate(table))
        assert np.allclose(d, ((q - coded) ** 2).sum(1))


def test_shards_are_bounded():
    held = {0: 5, 1: 3, 2: 25, 3: 1, 5: 10, 6: 1}
    first, number = shards(held, 7, 10)
    assert number.tolist() == [1, 1, 3, 1, 1, 1, 1] and first.tolist()[:3] == [0, 0, 1]
    load = {}
    for i in range(7):
        for k in range(number[i]):
            load[first[i] + k] = load.get(first[i] + k, 0) + held.get(i, 0) / number[i]
    assert max(load.values()) <= 10 and round(sum(load.values()), 6) == sum(held.values())


def test_search_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = search(table, F.col("id") % 100 == 0).collect()
    rows = table.collect()
    ids = np.array([r.vec_id for r in rows])
    points = np.array([r.embedding for r in rows], float)
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        d = ((points - points[ids == q]) ** 2).sum(1)
        d[ids == q] = np.inf
        hit += len(set(ids[np.argsort(d)[:10]]) & {r.id for r in got if r.query == q})
        total += 10
    assert hit >= 0.9 * total


def test_rerank_depth_grows_with_the_table():
    assert [depth(n) for n in (1, 2_000, 32_000, 20_000_000)] == [200, 200, 400, 2000]
