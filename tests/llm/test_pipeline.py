"""The pipeline against brute-force versions of its stages, on a small planted corpus."""

import random

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from scenelake.llm import queries

from test_dedup import brute_components, brute_exact, brute_fingerprint, brute_repeats  # isort: skip


def corpus():
    rng = random.Random(7)
    vocabulary = {"en": "the and house garden river of is".split(), "de": "der und haus garten fluss von ist".split()}
    rows = []
    for i in range(80):
        lang = ("en", "de")[i % 2]
        rows.append((i, " ".join(f"{rng.choice(vocabulary[lang])}{rng.randrange(40)}" for _ in range(100)), lang))
    passage = " ".join(f"passage{k}" for k in range(70))
    rows += [(100 + i, f"{rows[i][1]} {passage}", rows[i][2]) for i in range(5)]
    rows += [(120 + i, rows[i][1].replace(" ", "\n"), rows[i][2]) for i in range(4)]
    rows += [(140, None, "en"), (141, "123 456", "en"), (142, rows[7][1] + ".", "de")]
    return rows


def test_pipeline(spark, documents, tmp_path):
    rows = corpus()
    documents(rows).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    left = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    keep = {k for _, k, _, _ in brute_exact(left)}
    left = [r for r in left if r[0] in keep]
    group = brute_components({i: brute_fingerprint(t) for i, t, _ in left})
    left = [r for r in left if group[r[0]] == r[0]]
    texts = {i: (kept if gone else next(t for j, t, _ in left if j == i)) for i, _, gone, kept in brute_repeats(left, 50)}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r.doc_id for r in got} == set(texts)
    for i, t in texts.items():
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        ids = [x for r in own for x in np.frombuffer(r.ids, "<u4").tolist()]
        assert ids == [*library.encode(t, add_special_tokens=False).ids, 0]


def test_every_query_is_registered():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 11))
    assert "pipeline" in names and corpus_pipeline.ORACLE_SQL is None
    assert len(corpus_pipeline.STAGES) == 5
