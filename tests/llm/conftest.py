import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from (doc_id, text) pairs, dealt over several files, with
    further columns whose names clash with results."""

    def make(rows, extra=""):
        data = [(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows]
        frame = spark.createDataFrame(data, COLUMNS)
        for name in extra.split():
            frame = frame.selectExpr("*", f"'x' AS `{name}`")
        return frame.coalesce(3)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, very long, repeated and strange texts."""
    rng = random.Random(5)
    words = "the of and a to in is you that it he was for on are".split()
    return [
        None, "", " ", "\n\t ", "one", "a a a a a a a a a a a a",
        " ".join(rng.choice(words) for _ in range(30_000)),
        "x" * 50_000,
        "Tabs\tand\x0bodd\x0cspaces\x1c\x85\xa0here 中文 💡 é 'tis it's \x00 nul",
        "same text here of some words", "same text here of some words",
        "<|endoftext|> MiXeD Case 123,456.78 -- $%& | #",
        "two  blanks   three \n \n lines \r\n end ",
    ]


@pytest.fixture(scope="session")
def odd_rows(odd_texts):
    rows = list(enumerate(odd_texts))
    return rows + [(5, odd_texts[5]), (None, "without an id"), (None, None)]
