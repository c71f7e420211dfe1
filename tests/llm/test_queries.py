"""Text queries against their SQL, and odd input of the operators."""

import glob
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scenelake.llm import language_id as li
from scenelake.llm import queries
from scenelake.llm.bpe import encode
from scenelake.llm.packing import pack

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, name):
    with duckdb.connect() as db:
        for path in glob.glob(f"{SF}/*.parquet"):
            db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
        found = db.execute(queries.oracle_sql()[name])
        names = [c[0] for c in found.description]
        want = found.fetchall()
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    got = df.select(*names).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want))


def grams(text):
    """The n-grams of a text, as plain sets of class tuples."""
    c = [0, *(int(li._CLASSES[b]) for b in text), 0]
    return {tuple(c[i : i + n]) for n in (1, 2, 3) for i in range(len(c) - n + 1)}


def test_language_scores_equal_exact_kernel_ridge():
    """With every text a landmark the Nyström map is whole: scores are those of plain kernel ridge regression."""
    rng = random.Random(2)
    words = {"en": "the house and garden of rain".split(), "de": "das haus und der garten regen".split(), "fr": "la maison été où ça".split()}
    texts, languages = [], []
    for lang, own in words.items():
        for _ in range(8):
            texts.append(" ".join(rng.choice(own) for _ in range(12)).encode())
            languages.append(lang)
    model = li.fit(texts, languages, landmarks=8)
    sets = [grams(t) for t in texts]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    gram = np.array([[kernel(a, b) for b in sets] for a in sets])
    names = sorted(words)
    target = np.array([[float(x == n) for n in names] for x in languages])
    alpha = np.linalg.solve(gram + li.RIDGE * np.eye(len(texts)), target)
    asked = [b"the garten", "maison où".encode(), b"regen regen", *texts[:5]]
    want = np.array([[kernel(grams(t), s) for s in sets] for t in asked]) @ alpha
    assert model.languages == names and np.allclose(model.scores(asked), want, atol=2e-3)


def test_language_ties_repeats_and_long_texts(documents):
    """Equal scores go to the language first in order; repeated rows and long texts are scored each."""
    tied = li.fit([b"same text"] * 4, ["b", "a", "b", "a"])
    assert tied.predict([b"same text"])[0] == ["a"]
    long = "the house and the garden " * 40_000
    rows = [(i, "the house and the garden", "en") for i in range(8)] + [(20 + i, "das haus und der garten", "de") for i in range(8)]
    model = li.learn(documents(rows))
    got = li.identify(documents([(1, long, None), (1, long, None), (2, "", None)]), model).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in got) == [(1, "en"), (1, "en"), (2, "und")]


def test_packing_repeated_rows(documents):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = pack(documents([(7, "a b c", None)] * 3 + [(7, None, None)]), path, length=4).collect()
    assert sum(r.length for r in got) == 3 * 4 + 1 and {r.doc_tokens for r in got} == {4, 1}
    places = sorted(r.sequence * 4 + r.offset + k for r in got for k in range(r.length))
    assert places == list(range(13))


def test_pipeline_of_nothing(spark, documents, tmp_path):
    import corpus_pipeline

    empty = [(1, "x", "en")]
    documents(empty).limit(0).write.parquet(f"file://{tmp_path}/a/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/a").count() == 0
    documents([(1, None, "en"), (2, None, None), (2, None, None)]).write.parquet(f"file://{tmp_path}/b/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/b").count() == 0


def test_pipeline_of_repeated_ids(spark, documents, tmp_path):
    import corpus_pipeline

    rows = [(5, f"the house number {i} and the garden behind it", "en") for i in range(4)] + [(None, "das haus und der garten am fluss", "de")]
    documents(rows).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    places = sorted(r.sequence_id * 1024 + r.offset + k for r in got for k in range(r.length))
    assert places == list(range(len(places))) and {r.doc_id for r in got} == {5, None}


def test_encode_keeps_clashing_columns_out(documents):
    import public_tokenizers

    docs = documents([(1, "a b", None)]).withColumn("ids", F.lit("x"))
    assert encode(docs, public_tokenizers.path("word_bpe_49k.json")).columns == ["id", "ids"]
