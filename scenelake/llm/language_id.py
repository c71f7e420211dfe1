"""Language identification with string kernels.

Kernel: the blended spectrum of presence, that is how many different byte n-grams of lengths one
to three two texts share, divided by the geometric mean of how many each has.  Nyström landmarks
(texts of every language) make it a map to few dimensions; kernel ridge regression, one language
against the rest, is solved there.  Scoring is batched: presence of landmark n-grams times the
landmarks' presence gives the kernel rows, and these times the weights give all scores.

Text is read as UTF-8 with ASCII capitals made small and all other ASCII but letters made spaces.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.llm.bpe import slices, utf8

SPECTRUM = 3
#: Texts of each language to learn from, and landmarks among them.
PER_LANGUAGE = 96
LANDMARKS = 24
RIDGE = 0.05
#: The remainder of crc32(id) modulo this is 0 for rows that are never learned from.
FOLDS = 5
UNKNOWN = "und"
#: Byte classes: 0 for spaces, 1 to 26 for letters, then one for each byte beyond ASCII.
_CLASSES = np.array(
    [(b | 32) - 96 if chr(b).isalpha() else 0 for b in range(128)] + list(range(27, 155)), np.int32
)
_N = 155
#: The first code of the n-grams of each length.
_FIRST = np.concatenate(([0], np.cumsum([_N**n for n in range(1, SPECTRUM + 1)])))
_CELLS = 4_000_000  # of a batch's presence matrix
_SCRATCH: list[np.ndarray] = []


def spectrum(text: bytes) -> np.ndarray:
    """The codes of the different n-grams of a text between two spaces."""
    c = np.zeros(len(text) + 2, np.int64)
    c[1:-1] = _CLASSES[np.frombuffer(text, np.uint8)]
    parts, code = [c], c
    for n in range(2, SPECTRUM + 1):
        code = code[:-1] * _N + c[n - 1 :]
        parts.append(_FIRST[n - 1] + code)
    codes = np.concatenate(parts)
    if not _SCRATCH:
        _SCRATCH.append(np.empty(_FIRST[-1], np.int32))
    places = np.arange(len(codes), dtype=np.int32)
    _SCRATCH[0][codes] = places  # the last place of a code stays
    return codes[_SCRATCH[0][codes] == places]


def has_letter(text: bytes) -> bool:
    """Whether any character is a letter in Unicode."""
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


@dataclass(frozen=True)
class Model:
    """Landmark n-grams, their presence in each landmark, and weights of each language."""

    languages: list[str]
    vocabulary: np.ndarray
    presence: np.ndarray  # n-grams x landmarks
    weights: np.ndarray  # landmarks x languages

    @cached_property
    def _index(self) -> np.ndarray:
        index = np.full(_FIRST[-1], -1, np.int32)
        index[self.vocabulary] = np.arange(len(self.vocabulary), dtype=np.int32)
        return index

    def kernel(self, texts: list[bytes]) -> np.ndarray:
        """Normalised kernel of each text with each landmark."""
        rows = np.zeros((len(texts), len(self.vocabulary)), np.float32)
        sizes = np.empty(len(texts), np.float32)
        for i, t in enumerate(texts):
            codes = spectrum(t)
            sizes[i] = len(codes)
            at = self._index[codes]
            rows[i, at[at >= 0]] = 1
        own = self.presence.sum(axis=0)
        return (rows @ self.presence) / np.sqrt(np.outer(sizes, own))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Texts x languages: about 1 for the language of a text and 0 for others."""
        step = max(1, _CELLS // max(1, len(self.vocabulary)))
        parts = [self.kernel(texts[a : a + step]) @ self.weights for a in range(0, len(texts), step)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)))

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Language and score from 0 to 1 of each text; texts without letters are unknown."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        found = self.scores(texts)
        best = found.argmax(axis=1)
        score = np.clip(found[np.arange(len(best)), best], 0, 1).astype(float)
        names = [self.languages[b] for b in best]
        for i, t in enumerate(texts):
            if not has_letter(t):
                names[i], score[i] = UNKNOWN, 0.0
        return names, score


def fit(texts: list[bytes], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression on the Nyström map of the first ``landmarks`` texts of a language."""
    names = sorted(set(languages))
    chosen = [
        t
        for name in names
        for t in [t for t, lang in zip(texts, languages) if lang == name][:landmarks]
    ]
    sets = [spectrum(t) for t in chosen]
    vocabulary = np.unique(np.concatenate(sets)) if sets else np.empty(0, np.int64)
    presence = np.zeros((len(vocabulary), len(sets)), np.float32)
    for j, s in enumerate(sets):
        presence[np.searchsorted(vocabulary, s), j] = 1
    bare = Model(names, vocabulary, presence, np.zeros((len(sets), len(names)), np.float32))
    if not names:
        return bare
    values, vectors = np.linalg.eigh(bare.kernel(chosen).astype(float))
    solid = values > 1e-6 * values.max()
    root = vectors[:, solid] / np.sqrt(values[solid])
    step = max(1, _CELLS // len(vocabulary))
    mapped = np.concatenate([bare.kernel(texts[a : a + step]) for a in range(0, len(texts), step)]) @ root
    target = (np.array(languages)[:, None] == np.array(names)).astype(float)
    gram = mapped.T @ mapped + ridge * np.eye(mapped.shape[1])
    weights = root @ np.linalg.solve(gram, mapped.T @ target)
    return Model(names, vocabulary, presence, weights.astype(np.float32))


def held_out(id_col: str):
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")), F.lit(0)) % FOLDS == 0


def learn(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
    landmarks: int = LANDMARKS,
) -> Model:
    """Fit on at most ``per_language`` labelled texts of each language, chosen by hash of the id.

    Only rows with text, label and id that aren't held out count.  The driver gets the number of
    rows of each language, then about 1.5 times the bounded sample.
    """
    usable = docs.where(
        F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)
    )
    counts = {r[0]: r[1] for r in usable.groupBy(F.col(lang_col)).agg(F.count("*")).collect()}
    if not counts:
        return fit([], [])
    share = F.pmod(F.xxhash64(F.lit(1), F.col(id_col)), F.lit(1 << 20)) / float(1 << 20)
    pairs = [x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit((1.5 * per_language + 20) / n))]
    rows = (
        usable.where(share < F.create_map(*pairs)[F.col(lang_col)])
        .select(share.alias("s"), F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.encode(text_col, "utf-8").alias("t"))
        .collect()
    )
    texts, languages, taken = [], [], dict.fromkeys(counts, 0)
    for r in sorted(rows, key=lambda r: (r.s, str(r.i), r.t)):
        if taken[r.l] < per_language and has_letter(r.t):
            taken[r.l] += 1
            texts.append(bytes(r.t))
            languages.append(r.l)
    return fit(texts, languages, landmarks)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``lang_pred`` and ``lang_score``.

    Null texts and texts without letters are ``und`` with score 0; so is everything if the model
    has learned nothing.  Repeated rows are scored each; an empty table gives no rows.  Columns of
    ``docs`` that already have one of the two names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the landmarks
    new = ("lang_pred", "lang_score")
    kept = [c for c in docs.columns if c.lower() not in new]
    at = kept.index(text_col)
    own = docs.select(*(F.col(f"`{c}`") for c in kept))
    schema = own.withColumn(new[0], F.lit("")).withColumn(new[1], F.lit(0.0)).schema

    def batches(it):
        for batch in it:
            for part in slices(batch):
                names, scores = shared.value.predict(utf8(part.column(at)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names, pa.string()), pa.array(scores)],
                    names=[*kept, *new],
                )

    return own.mapInArrow(batches, schema)
