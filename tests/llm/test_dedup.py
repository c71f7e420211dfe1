"""Exact, near and substring dedup against brute force, with odd rows."""

import hashlib
import random
import re

import numpy as np
import xxhash

from scenelake.llm import exact_dedup, simhash, substring_dedup
from scenelake.llm.components import components
from scenelake.llm.exact_dedup import exact_duplicates, without_duplicates
from scenelake.llm.simhash import near_duplicates, without_near_duplicates
from scenelake.llm.substring_dedup import remove_repeats, without_repeats


def brute_exact(rows):
    best, n = {}, {}
    for at, (i, t, _) in enumerate(rows):
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        mine = (-len(t or ""), i is None, i or 0, at)
        n[key] = n.get(key, 0) + 1
        best[key] = min(best.get(key, mine + (i,)), mine + (i,))
    out = []
    for i, t, _ in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        out.append((i, best[key][-1], n[key], hashlib.sha256(key.encode()).hexdigest()))
    return out


def test_exact(documents, odd_texts):
    rows = odd_texts + [(20 + i, "a b" + " " * (i % 3), "en") for i in range(300)]
    got = exact_duplicates(documents(rows)).collect()
    key = lambda r: repr(tuple(r))
    assert sorted(((r.id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(brute_exact(rows), key=key)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.id == r.keep_id for r in kept)
    assert next(r.keep_id for r in got if r.id == 25) == 22  # two spaces are more code points


def test_exact_over_many_runs_and_rounds(documents):
    """More runs than one merge takes: copies within runs, across runs of a group and across groups."""
    rng = random.Random(5)
    rows = [(i, rng.choice(["a b", "ab ", "a  b", f"t{rng.randrange(90)}", "", None]), "en") for i in range(900)]
    docs = documents(rows).repartition(21)
    want = sorted(repr((i, k, n)) for i, k, n, _ in brute_exact([(i, t, x) for i, t, x in rows]))
    assert [exact_dedup.rounds(n, 2) for n in (0, 1, 2, 4, 5, 16, 17, 21, 64, 65)] == [1, 1, 1, 1, 2, 2, 3, 3, 3, 4]
    for fan_bits in (1, 2, 6):
        got = exact_duplicates(docs, fan_bits=fan_bits)
        assert sorted(repr((r.id, r.keep_id, r.group_size)) for r in got.collect()) == want


def test_every_round_merges_runs(spark, documents):
    """One exchange by run and segment a round, and each level holds what its runs have."""
    rows = exact_dedup.digests(documents([(i, f"t{i % 7}", "en") for i in range(64)]).repartition(8), "doc_id", "text")
    runs = exact_dedup.sorted_runs(rows)
    root = exact_dedup.merge_runs(runs, 8, fan_bits=1)
    assert sorted(r.n for r in root.collect()) == sorted([10] + [9] * 6)
    plan = root._jdf.queryExecution().executedPlan().toString()
    assert len(set(re.findall(r"Exchange hashpartitioning\((run#\d+)L?, segment#\d+, \d+\)", plan))) == 3


def test_texts_of_other_length_or_hash_never_merge(spark):
    rows = [(1, 3, b"d", 3, 1, 0), (2, 3, b"d", 3, 2, 1), (3, 3, b"d", 4, 1, 2), (4, 3, b"d", 3, 1, 3)]
    entries = exact_dedup.sorted_runs(spark.createDataFrame(rows, "id long, points int, digest binary, size int, check long, row long"))
    assert sorted(r.n for r in exact_dedup.merge_runs(entries, 1).collect()) == [1, 1, 2]


def test_exact_with_other_ids(spark):
    docs = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "x")], "doc_id string, text string")
    assert {r.keep_id for r in exact_duplicates(docs).collect()} == {"a"}


def test_exact_keeps_rows_whole(documents, odd_texts):
    docs = documents(odd_texts)
    kept = without_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "5", "6", "7", "8", "9"]
    assert without_duplicates(docs.limit(0)).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    label = {i: i for i in prints}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash_matches_brute_force(documents, odd_texts):
    rng = random.Random(1)
    base = [f"t{rng.randrange(500)}" for _ in range(400)]
    near = [(100 + i, " ".join(base[:200] + [f"n{i}"] + base[200:]), "en") for i in range(40)]
    rows = [r for r in odd_texts if r[0] != 7 or r[1]] + near + [(200, "Ab c", None), (201, "aB  c", None)]
    want = {i: brute_fingerprint(t) for i, t, _ in rows if i is not None}
    group = brute_components(want)
    for limit in (256, 2):  # 2: every block takes the way for large blocks
        for r in near_duplicates(documents(rows), max_compared=limit).collect():
            if r.id is None:
                assert r.component is None
            else:
                assert (r.fp & (2**64 - 1), r.component) == (want[r.id], group[r.id])


def test_simhash_links_over_chains_and_blocks(spark):
    rng = random.Random(2)
    prints = {}
    for i in range(300):
        if i and rng.random() < 0.7:
            prints[i] = prints[rng.randrange(i)] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        else:
            prints[i] = rng.getrandbits(64)
    group = brute_components(prints)
    first = {}
    for i, fp in sorted(prints.items()):
        first.setdefault(fp, i)
    rows = [(fp - (1 << 64) if fp >> 63 else fp, i) for fp, i in first.items()]
    for limit in (256, 1):
        found = components(simhash.links(spark.createDataFrame(rows, "fp long, rep long"), limit)).collect()
        got = {r.node: r.label for r in found}
        assert all(got.get(i, i) == group[i] for i in first.values())


def test_near_duplicates_stay_once(documents):
    docs = documents([(1, "a b c d", "en"), (2, "A b  c d", "en"), (3, "other words here now", "en"), (None, "a b c d", None)])
    assert sorted(str(r.doc_id) for r in without_near_duplicates(docs).collect()) == ["1", "3", "None"]
    assert near_duplicates(docs.limit(0)).count() == 0


def brute_repeats(rows, window):
    first, out = {}, []
    split = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t, _ in rows]
    for i, w in split:
        for k in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = b" ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((i, len(w), len(gone), kept.decode()))
    return out


def test_substring_matches_brute_force(documents, odd_texts):
    rng = random.Random(3)
    shared = [f"s{i}" for i in range(60)]
    more = [
        (50 + i, " ".join([f"r{rng.randrange(50)}" for _ in range(rng.randrange(80))] + shared[: rng.randrange(45, 61)]), "en")
        for i in range(60)
    ]
    rows = odd_texts + more
    for kw in ({}, {"chunk_chars": 2000, "bucket_windows": 50}, {"window": 5}):
        got = remove_repeats(documents(rows), **kw).collect()
        want = brute_repeats(rows, kw.get("window", 50))
        assert sorted(map(repr, ((r.id, r.n_words, r.n_removed, r.kept) for r in got))) == sorted(map(repr, want))
        assert all(sum(b - a for a, b in r.spans) == r.n_removed for r in got)


def test_substring_keeps_columns(documents, odd_texts):
    docs = documents(odd_texts)
    got = without_repeats(docs)
    assert got.columns == docs.columns and got.count() == len(odd_texts)
    assert {r.doc_id: r.text for r in got.collect()}[3] is None
    assert without_repeats(docs.limit(0)).count() == 0


def test_substring_with_weak_hashes_is_verified(documents, odd_texts):
    """Windows that only share a hash are never taken as equal, in a chunk or between chunks."""
    rng = random.Random(4)
    rows = odd_texts[:8] + [(50 + i, " ".join(rng.choice("ab") for _ in range(60)), "en") for i in range(30)]
    want = sorted(map(repr, brute_repeats(rows, 6)))
    for kw in ({"chunk_chars": 300}, {"chunk_chars": 10**9}):
        got = remove_repeats(documents(rows), window=6, hash_bits=5, **kw).collect()
        assert sorted(map(repr, ((r.id, r.n_words, r.n_removed, r.kept) for r in got))) == want


def test_substring_with_one_hot_id(documents):
    """Rows of one id, a third of all and more than a chunk, don't affect each other, others do."""
    rng = random.Random(6)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(7 if i % 3 else i, f"{passage} x{i} " + " ".join(f"r{rng.randrange(9)}" for _ in range(30)), "en") for i in range(120)]
    got = remove_repeats(documents(rows), chunk_chars=1500, bucket_windows=100).collect()
    want = brute_repeats(rows, 50)
    assert sorted(map(repr, ((r.id, r.n_words, r.n_removed, r.kept) for r in got))) == sorted(map(repr, want))
    assert {r.n_removed >= 60 for r in got if r.id == 7} == {True} and next(r.n_removed for r in got if r.id == 0) == 0


def test_rolling_hash_equals_the_polynomial():
    prime = substring_dedup.PRIME
    rng = np.random.default_rng(1)
    words = np.concatenate((rng.integers(0, prime, 300, dtype=np.uint64), np.array([0, prime, prime - 1, 1] * 5, np.uint64)))
    got = substring_dedup._rolled(words, 50).tolist()
    powers = [pow(substring_dedup._BASE, k, prime) for k in range(50)]
    want = [sum(int(w) * p for w, p in zip(words[i : i + 50], powers)) % prime for i in range(len(words) - 49)]
    assert got == want


def test_structured_windows_spread():
    """Swapped words and Thue-Morse blocks, where polynomials modulo powers of two lose bits."""
    a, b = substring_dedup.word_hashes([b"a", b"b"])
    blocks = [np.array([a if bin(i ^ flip).count("1") % 2 else b for i in range(64)]) for flip in (0, 1, 63)]
    blocks += [np.array([a] * k + [b] + [a] * (63 - k)) for k in range(64)]
    hashes = [int(substring_dedup._rolled(x, 64)[0]) for x in blocks]
    same = len({tuple(x.tolist()) for x in blocks})
    assert len(set(hashes)) == same
    assert len({h & 0xFFFF for h in hashes}) > 0.9 * same and len({h >> 45 for h in hashes}) > 0.9 * same


def test_buckets_are_even_ranges():
    words = substring_dedup.word_hashes([b"w%d" % i for i in range(20000)])
    buckets = substring_dedup.bucket_of(substring_dedup._rolled(words, 50), 100)
    sizes = np.bincount(buckets, minlength=100)
    assert len(sizes) == 100 and sizes.min() > 130 and sizes.max() < 280
