import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, fp int"


@pytest.fixture(scope="session")
def documents(spark):
    """Build documents with extra columns whose names clash with scratch and result names."""

    def build(rows):
        full = [(i, t, lang, "s", len(t or ""), "own", 7) for i, t, lang in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd_texts():
    words = [f"w{i}" for i in range(120)]
    return [
        (1, " ".join(words), "en"),
        (2, "\n".join(words), "en"),
        (3, None, None),
        (4, "", "en"),
        (5, "x", None),
        (6, "pre " + " ".join(words[10:90]) + " post", "de"),
        (7, " ".join(words[:49]), "de"),
        (7, " ".join(words[:49]), "de"),
        (None, " ".join(words), "en"),
        (8, "é  ß <|endoftext|> It's  two\t\ttabs 42", "fr"),
        (9, " ".join(f"long{i % 977}" for i in range(30000)), "fr"),
    ]
