"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that never occurs inside any vocabulary token marks a certain cut: no merge can join
its two sides.  Byte strings are cut there, every different fragment is encoded once by itself and
remembered, and the ids are concatenated.  Two kinds of vocabulary are known:

* with an end-of-word suffix: the suffix is one more byte, 0xFF, which UTF-8 never has.  Words between
  white space are normalised and parted into pre-tokens, each closed by that byte; then pre-tokens are
  joined by spaces and the whole is cut at all forced boundaries at once, inside words and between
  them.  A word's last fragment thus has the suffix, its others don't.
* byte-level without suffix: white space belongs to the word after it and is kept, so cuts are
  before a space or line feed that follows anything but white space, and after a lone line feed.
  Texts with runs of white space or with white space beyond ASCII are cut only where ASCII that
  isn't white space meets a space or line feed.

The contents of special tokens count as vocabulary, so a cut never divides them.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fragments whose ids a worker remembers for a vocabulary, and texts handled at a time.
_REMEMBERED = 800_000
_AT_A_TIME = 256
_SPACES = b"\t\n\x0b\x0c\r "
#: White space beyond ASCII in UTF-8; some vocabularies have tokens that mix it with ASCII's.
_WIDE = rb"\xC2[\x85\xA0]|\xE1\x9A\x80|\xE2\x80[\x80-\x8A\xA8\xA9\xAF]|\xE2\x81\x9F|\xE3\x80\x80"
_WIDE_SPACE = re.compile(_WIDE)
_ODD = re.compile(rb"[\x20\x09-\x0D]{2}|" + _WIDE)
_BEFORE_SPACE = re.compile(rb"(?<=[\x00-\x08\x0E-\x1F\x21-\x7F])(?=[ \n])")


_LONG_SPACE = re.compile(rb"(?:[\x20\x09-\x0D]|" + _WIDE + rb"){500}")
#: The end-of-word suffix as a byte, and what closes a pre-token.
_END = 0xFF
_CLOSE = bytes([_END])
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Fixed value: the pre-token pattern of byte-level vocabularies.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_alphabet() -> dict[str, int]:
    """Characters of byte-level vocabularies and the bytes that they stand for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """A tokenizer file with the cuts of its vocabulary and a memory of fragments."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.decoder = (spec.get("decoder") or {}).get("type")
        special = {t["content"] for t in spec["added_tokens"]}
        alphabet = _byte_alphabet()
        self.inside = np.zeros((256, 256), bool)
        self.inside_narrow = np.zeros((256, 256), bool)  # without the tokens that hold wide spaces
        top = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
        self.shown: list[str] = [""] * (top + 1)
        self.raw: list[bytes] = [b""] * (top + 1)
        for token, i in [*spec["model"]["vocab"].items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]:
            self.shown[i] = token
            if token in special:
                raw = token.encode()
            else:
                raw = bytes(alphabet[c] for c in token.removesuffix(self.suffix) if c in alphabet)
            self.raw[i] = raw
            pairs = np.frombuffer(raw, np.uint8)
            self.inside[pairs[:-1], pairs[1:]] = True
            if not _WIDE_SPACE.search(raw):
                self.inside_narrow[pairs[:-1], pairs[1:]] = True
        self.special = sorted(t.encode() for t in special)
        self.alphabet = alphabet
        if self.suffix:  # every byte can end a word
            self.inside[:, _END] = True
            self.inside[list(_SPACES), _END] = False
            self.inside[_END] = False
        self.merge = self._merge_loop(spec["model"]) if self.suffix else None
        self.engine = self._engine(spec["model"], special)
        if self.suffix and self.engine is not None:
            self.merge = self.engine._encode_single_piece
        self.words: dict[bytes, bytes] = {}
        self.fragments: dict[bytes, bytes] = {}
        self.spaced: dict[bytes, bytes] = {}
        self.check()

    def _engine(self, model: dict, special: set[str]):
        """A faster coder with the same results, if ids rise in the order of merges, else None.

        Every byte joins the end-of-word byte before any other merge, as ids of bytes with suffix are
        below those of merges.
        """
        import tiktoken

        vocab, base = model["vocab"], 512 if self.suffix else 256
        merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        if None in merged or merged != sorted(set(merged)) or (merged and merged[0] < base):
            return None
        end = bytes([_END]) if self.suffix else b""
        ranks = {}
        for token, i in vocab.items():
            if token not in special:
                ranks[self.raw[i] + (end if self.suffix and token.endswith(self.suffix) else b"")] = i
        singles = [bytes([b]) for b in range(256)]
        if any(x not in ranks for x in singles) or self.suffix and any(x + end not in ranks for x in singles):
            return None
        ids = {t: i for i, t in enumerate(self.shown) if t in special}
        return tiktoken.Encoding("own", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=ids)

    def encode_whole(self, texts: list[bytes]) -> list[bytes]:
        """Ids as :meth:`encode` gives them; byte-level vocabularies go through the fast coder."""
        if self.suffix or self.engine is None:
            return self.encode(texts)
        out = []
        for t in texts:
            if _LONG_SPACE.search(t):  # the coder's pattern could give up
                out.append(self.encode([t])[0])
            else:
                out.append(self.engine.encode_to_numpy(t.decode(), allowed_special="all").astype("<u4").tobytes())
        return out

    def check(self) -> None:
        """The cuts at white space must be certain in this vocabulary."""
        spaces = list(_SPACES)
        solid = [b for b in range(256) if b not in spaces]
        if self.suffix:
            bad = self.inside[spaces].any() or self.inside[:, spaces].any()
        else:
            narrow = self.inside_narrow
            bad = narrow[np.ix_(solid, [0x20, 0x0A])].any() or narrow[0x0A, solid].any()
            bad |= self.inside[np.ix_([b for b in solid if b < 128], [0x20, 0x0A])].any()
        if bad:
            raise ValueError("white space doesn't mark certain cuts in this vocabulary")

    def _merge_loop(self, model: dict):
        """Ids of one fragment: merges in their order, of equal ones the leftmost first.

        For vocabularies that the faster coder can't take.
        """
        end, vocab = bytes([_END]), model["vocab"]

        def raw(token: str) -> bytes:
            body = token.removesuffix(self.suffix)
            return bytes(map(self.alphabet.__getitem__, body)) + (end if token.endswith(self.suffix) else b"")

        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        order = {(raw(a), raw(b)): at for at, (a, b) in reversed(list(enumerate(merges)))}
        special = {t.decode() for t in self.special}
        ids = {raw(t): i for t, i in vocab.items() if t not in special}

        def merge(fragment: bytes) -> list[int]:
            parts = [bytes([b]) for b in fragment.removesuffix(end)]
            if fragment.endswith(end):
                parts[-1] += end
            while len(parts) > 1:
                at, i = min((order.get(pair, len(order)), i) for i, pair in enumerate(zip(parts, parts[1:])))
                if at == len(order):
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            return [ids[p] for p in parts]

        return merge

    def _ids(self, fragments: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(
            [f.decode() for f in fragments], add_special_tokens=False
        )
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _closed(self, word: bytes) -> bytes:
        """The pre-tokens of a word, normalised, each closed by the end-of-word byte, spaces between."""
        text = word.decode()
        if _LATIN.fullmatch(text):  # one pre-token, and small letters are its normal form
            return text.lower().encode() + _CLOSE
        normal = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        parts = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)
        return b" ".join(bytes(map(self.alphabet.__getitem__, p)) + _CLOSE for p, _ in parts)

    def split(self, closed: bytes) -> list[bytes]:
        """The fragments between forced boundaries; a space is one of its own."""
        at = np.frombuffer(closed, np.uint8)
        edges = [0, *(np.flatnonzero(~self.inside[at[:-1], at[1:]]) + 1).tolist(), len(closed)]
        return [closed[a:b] for a, b in zip(edges, edges[1:])]

    def _learn_words(self, missing: set[bytes]) -> None:
        """Remember the ids of words, put together from those of their fragments."""
        new = sorted(missing)
        if self.special:
            odd = [w for w in new if any(s in w for s in self.special)]
            self.words.update(zip(odd, self._ids(odd) if odd else []))
            new = [w for w in new if w not in self.words] if odd else new
        if not new:
            return
        pieces = self.split(b"\n".join(map(self._closed, new)) + b"\n")
        known = self.fragments
        if len(known) + len(pieces) > _REMEMBERED:
            known.clear()
        for f in {*pieces} - known.keys() - {b" ", b"\n"}:
            known[f] = np.array(self.merge(f), "<u4").tobytes()
        known[b" "] = b""
        ids: list[bytes] = []
        word = iter(new)
        for f in pieces:
            if f == b"\n":
                self.words[next(word)] = b"".join(ids)
                ids.clear()
            else:
                ids.append(known[f])

    def _learn(self, memory: dict[bytes, bytes], missing: set[bytes], before: bytes = b"") -> None:
        new = sorted(missing)
        memory.update(zip(new, self._ids([before + f for f in new])))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text, as little-endian unsigned 32-bit integers."""
        return self._encode_words(texts) if self.suffix else self._encode_spaced(texts)

    def _encode_words(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        wanted = set().union(*split) if split else set()
        if missing := wanted - self.words.keys():
            if len(self.words) + len(missing) > _REMEMBERED:
                self.words.clear()
                missing = wanted
            self._learn_words(missing)
        get = self.words.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def _encode_spaced(self, texts: list[bytes]) -> list[bytes]:
        lines: list[list[list[bytes]]] = []  # of a text, its lines' words; odd texts: one line of fragments
        odd: list[bool] = []
        first: set[bytes] = {b"\n"}
        after: set[bytes] = set()
        for t in texts:
            if _ODD.search(t):
                odd.append(True)
                lines.append([_BEFORE_SPACE.split(t)])
                first.update(lines[-1][0])
            else:
                odd.append(False)
                lines.append([line.split(b" ") for line in t.split(b"\n")])
                for words in lines[-1]:
                    first.add(words[0])
                    after.update(words[1:])
        for memory, wanted, before in ((self.words, first, b""), (self.spaced, after, b" ")):
            if missing := wanted - memory.keys():
                if len(memory) + len(missing) > _REMEMBERED:
                    memory.clear()
                    missing = wanted
                self._learn(memory, missing, before)
        get, spaced, feed = self.words.__getitem__, self.spaced.__getitem__, self.words[b"\n"]
        out = []
        for is_odd, text in zip(odd, lines):
            if is_odd:
                out.append(b"".join(map(get, text[0])))
            else:
                out.append(feed.join([get(w[0]) + b"".join(map(spaced, w[1:])) for w in text]))
        return out

    def decode(self, ids: list[bytes]) -> list[str]:
        """Texts of encoded ids, special tokens shown; without a decoder tokens stay as they are,
        joined by one space."""
        out = []
        for packed in ids:
            own = np.frombuffer(packed, "<u4").tolist()
            if self.decoder is None:
                out.append(" ".join(map(self.shown.__getitem__, own)))
            elif self.decoder == "ByteLevel":
                out.append(b"".join(map(self.raw.__getitem__, own)).decode("utf-8", "replace"))
            else:
                out.append(self.tokenizer.decode(own, skip_special_tokens=False))
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, loaded once in each worker."""
    return Encoder(path)


def slices(batch: pa.RecordBatch, rows: int = _AT_A_TIME):
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def utf8(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): token ids of every whole text, packed as little-endian unsigned 32-bit integers.

    ``path`` is a tokenizer file that every executor has.  Null and empty texts have no tokens,
    repeated rows are encoded each, an empty table gives no rows, other columns aren't read.  A long
    text is held whole by its task, with its words and ids; what is remembered of others is bounded.
    """

    def batches(it):
        own = encoder(path)
        for batch in it:
            for part in slices(batch):
                ids = pa.array(own.encode(utf8(part.column(1))), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(
        batches, "id long, ids binary"
    )


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(id, ids, text): the texts of packed ids as :func:`encode` gives them; null ids are empty."""

    def batches(it):
        own = encoder(path)
        for batch in it:
            for part in slices(batch):
                texts = own.decode([i or b"" for i in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.string())], names=["id", "ids", "text"]
                )

    return encoded.select("id", "ids").mapInArrow(batches, "id long, ids binary, text string")
