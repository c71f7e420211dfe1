"""Tokens, packing, languages, main text and licences."""

import json
import zlib
from functools import lru_cache
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scenelake.llm.bpe import Encoder, decode, encode, encoder
from scenelake.llm.html_text import extract, main_text
from scenelake.llm.language_id import fit, has_letter, held_out, identify, learn
from scenelake.llm.licence_texts import DIGESTS, LICENCES, NAMES
from scenelake.llm.licences import oracle, scan
from scenelake.llm.packing import pack

VOCABULARIES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = [
    "", "  a  b", "x\n\n y", "foo <|endoftext|> bar<|startoftext|>!", "It's we'll 'S DON'T d'été 'stuff 'reread",
    "a1b22c—é ü  x  y z", "ÁB é İIſ Σς ΣΑΣ", "tab\tx \r\n z ", "\n a\n", "!!'s ''t a''s", "日本語 テキスト です", "<|endoftext|>",
    "mixed123abc!@#def  ", "\x1c a\x85b 　 c", "a\n b", "a \nb", "\n\n", " ", "a  ", "🙂🙂 ok🙂", "ͅ ̈a ́x",
    "voilà été   x\n y", " " * 700 + "x",
]


@pytest.mark.parametrize("name", VOCABULARIES)
def test_bpe_equals_the_library(spark, documents, odd_texts, name):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    rows = odd_texts + [(100 + i, t, None) for i, t in enumerate(ODD)]
    want = sorted(
        (str(i), *(lambda e: (e.ids, library.decode(e.ids, skip_special_tokens=False)))(library.encode(t or "", add_special_tokens=False)))
        for i, t, _ in rows
    )
    got = decode(encode(documents(rows), path), path).collect()
    assert sorted((str(r.id), np.frombuffer(r.ids, "<u4").tolist(), r.text) for r in got) == want
    own = encoder(path)
    texts = [(t or "").encode() for _, t, _ in rows]
    assert own.encode_whole(texts) == own.encode(texts)


def test_cuts_are_pairs_that_no_token_has():
    own = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    letters = range(ord("a"), ord("z") + 1)
    never = [bytes([x, y]) for x in letters for y in letters if not own.inside[x, y]]
    assert never and all(p.decode() not in token for p in never for token in own.shown)
    a, b = never[0], never[-1]
    word = b"some" + a[:1] + a[1:] + b"thing" + b + b"less"
    # the last fragment alone has the end-of-word byte; ids are those of the fragments, side by side
    parts = own.split(word + b"\xff")
    assert parts == [b"some" + a[:1], a[1:] + b"thing" + b[:1], b[1:] + b"less\xff"]
    got = np.frombuffer(own.encode([word + b" " + word])[0], "<u4").tolist()
    once = [i for p in parts for i in np.frombuffer(own.fragments[p], "<u4").tolist()]
    assert got == once * 2 and set(parts) <= own.fragments.keys()
    assert own.tokenizer.encode(word.decode(), add_special_tokens=False).ids == once
    # what a fragment gives decides: other ids for it show up in the text's
    own.words.clear()
    own.fragments[parts[1]] = np.array([7], "<u4").tobytes()
    assert 7 in np.frombuffer(own.encode([word])[0], "<u4").tolist()


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abjqxz'é,!1ſ\u0301日 "), max_size=30))
def test_fragments_and_the_plain_merge_loop(text):
    own = encoder(public_tokenizers.path("word_bpe_49k.json"))
    want = own.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.encode([text.encode()])[0], "<u4").tolist() == want
    plain = _plain_merges()
    for word in text.encode().split():
        for f in own.split(own._closed(word)):
            assert f == b" " or plain(f) == own.merge(f)


@lru_cache
def _plain_merges():
    own = encoder(public_tokenizers.path("word_bpe_49k.json"))
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return own._merge_loop(json.load(f)["model"])


def test_packing_is_gapless(documents, odd_texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [r for r in odd_texts if r[0] != 7]
    got = pack(documents(rows), path, length=64).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t, _ in rows}
    total = sum(map(len, ids.values()))
    for i, want in ids.items():
        own = sorted((r for r in got if r.id == i), key=lambda r: r.start)
        assert [x for r in own for x in np.frombuffer(r.ids, "<u4").tolist()] == want
        assert all(r.doc_tokens == len(want) and len(r.ids) == 4 * r.length for r in own)
    places = sorted(r.sequence * 64 + r.offset + k for r in got for k in range(r.length))
    assert places == list(range(total))
    assert pack(documents(rows).limit(0), path).count() == 0


def test_language_model(spark, documents):
    model = fit([b"the house and the garden", b"das haus und der garten"] * 4, ["en", "de"] * 4)
    names, scores = model.predict([b"the garden", b"der garten und", b"", b"123 !!", "été".encode()])
    assert names[:4] == ["en", "de", "und", "und"] and all(0 <= s <= 1 for s in scores)
    assert has_letter("é".encode()) and not has_letter(b"12 ?")
    docs = documents([(1, "abc", "en"), (2, None, "en"), (None, "12", None)]).withColumn("lang_pred", F.lit("old"))
    got = identify(docs, learn(docs))
    assert [c for c in got.columns if c == "lang_pred"] == ["lang_pred"] and got.count() == 3
    assert identify(docs, fit([], [])).where("lang_pred = 'und'").count() == 3
    assert identify(docs.limit(0), model).count() == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(docs, learn(docs)).where(held_out("doc_id")).select("doc_id", "lang", "lang_pred").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    assert sum(r.lang == r.lang_pred for r in got) > 0.98 * len(got)


def test_main_text():
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=x>menu</a></ul></nav>"
        "<div class=ad>Buy, buy, buy now, it is cheap.</div><article><h1>Head</h1><p><b>One, two &amp; three<br><p>Four\n  five"
        "</p><form>no</form><script>var a='</p>'</script></article><div class='comments'><p>Great, post, indeed, yes.</p></div>"
        "<aside>side</aside><footer>&copy; x</footer></body></html>"
    )
    assert main_text(page) == "Head\nOne, two & three\nFour five"
    for bad in ("", "<", "<p", "<!--", "<script>x", "</p></div>", "<a b='c"):
        assert isinstance(main_text(bad), str)
    assert main_text("<div>a<div>b</div>c</div>") == "a\nb\nc"
    deep = "<div>" * 3000 + "text" + "</div>" * 3000
    assert main_text(deep) == "text"


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, "<p>x"), (2, None, "<p>x")], "page_id long, url string, html string")
    assert sorted((r.id, r.text) for r in extract(pages).collect()) == [(1, ""), (2, "x"), (2, "x")]
    assert extract(pages.limit(0)).count() == 0


def test_licences(documents):
    mit, bsd = LICENCES[0][1], next(t for i, t in LICENCES if i == "BSD-3-Clause")
    notices = [
        "released under the MIT Licence", "licensed under CC BY-NC 4.0.", "Released under the MIT License.",
        "  * This software is distributed under the terms of the GNU General Public License, version 2 or later.",
        "// SPDX-License-Identifier: MPL-2.0", "Use is licensed under the MIT License.", "licensed under somebody's terms",
    ]
    rows = [
        (1, mit, None),
        (2, "Copyright (c) 2020 Some One\n\n" + mit.upper().replace("\n", "  \n"), None),
        (3, "# " + bsd.replace("COPYRIGHT HOLDER", "copyright owner"), None),
        (4, "before " + mit, None),
        (5, None, None),
        (6, "text\n" + "\n".join(notices), None),
        (7, "(The MIT License)\n\nCopyright Some One and others\n\n" + mit, None),
        (7, mit, None),
        (8, "word " * 200_000 + mit, None),
        (9, "", None),
    ]
    got = scan(documents(rows)).collect()
    by = {r.id: r for r in got if r.id != 7}
    assert [by[i].licence for i in (1, 2, 3, 4, 5, 6, 8, 9)] == ["MIT", "MIT", "BSD-3-Clause", None, None, None, None, None]
    assert [r.licence for r in got if r.id == 7] == ["MIT", "MIT"]
    assert (by[6].notices, by[6].n_notice_lines) == (["CC-BY-NC-4.0", "GPL-2.0-or-later", "MIT", "MPL-2.0"], 5) and by[1].notices == []
    assert scan(documents(rows).limit(0)).count() == 0


def test_licences_equal_their_sql(spark, documents):
    """Documents that hit the hash join, and notices, in Spark and in SQL."""
    rows = [(i, t, None) for i, (_, t) in enumerate(LICENCES)]
    rows += [(100 + i, f"x\nLicensed under {'the ' * (i % 2)}{n}.\nAll Rights Reserved", None) for i, (_, n) in enumerate(NAMES)]
    docs = documents(rows)
    got = scan(docs).withColumn("notices", F.array_join("notices", ",")).withColumnRenamed("id", "doc_id").toPandas()
    with duckdb.connect() as db:
        db.register("documents", docs.toPandas())
        want = db.execute(oracle("documents")).df()
    key = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).where(df.notna(), None).values.tolist()))
    assert sorted(got.columns) == sorted(want.columns) and key(got) == key(want)
    assert got.set_index("doc_id").licence[: len(LICENCES)].notna().all() and (got[got.doc_id >= 100].n_notice_lines == 1).all()


def test_long_licences(documents):
    apache = (Path(__file__).parent / "apache_2.txt").read_text()
    terms = apache[: apache.index("APPENDIX")]
    filled = apache.replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2020 Some One")
    rows = [(1, apache, None), (2, terms, None), (3, filled.replace("http:", "https:"), None), (4, apache + "more", None)]
    long = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    files = {n: Path("/usr/share/common-licenses", n) for n in long}  # where Debian has them
    here = [n for n in files if files[n].exists()]
    rows += [(10 + i, files[n].read_text(), None) for i, n in enumerate(here)]
    got = {r.id: r.licence for r in scan(documents(rows)).collect()}
    assert [got[i] for i in range(1, 5)] == ["Apache-2.0"] * 3 + [None]
    assert [got[10 + i] for i in range(len(here))] == [long[n] for n in here]
    assert len({d for _, d in DIGESTS}) == len(DIGESTS)


def test_reserved_lines(documents):
    rows = [(1, "a\n# All rights reserved.\nb", None), (2, "all rights reserved by us", None), (3, None, None)]
    got = {r.id: r.n_reserved_lines for r in scan(documents(rows)).collect()}
    assert got == {1: 1, 2: 0, 3: 0}


def test_main_text_keeps_the_whole_article():
    long, side = "<p>" + "long text, " * 20 + "</p>", "b" * 200
    page = f"<body><article><h1>T</h1><div class=entry>{long * 10}</div><div>{side}</div><ul><li>item</ul><nav>menu</nav></article></body>"
    lines = main_text(page).split("\n")
    assert lines[0] == "T" and lines[-2:] == [side, "item"] and len(lines) == 13
    for name in ("content has-sidebar", "post no-comments", "content sidebar-left"):
        assert main_text(f"<body><div class='{name}'>{long}</div></body>")
    for name in ("content-sidebar", "post post-footer", "sidebar"):
        assert "x y z" not in main_text(f"<body><div class=content>{long}<div class='{name}'>x y z</div></div></body>")
