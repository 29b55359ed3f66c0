from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, shard long, rep long, n long, score double, toxic int, words binary, target boolean"


def made_texts() -> list[str | None]:
    """Short prose with copies, near copies, shared passages, and odd cases."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeéiorst") for _ in range(r.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage = text(120), text(70)
    near = base.split()
    near[60] = "changed"
    out: list[str | None] = [None, "", "   \n\t ", "one", "one", "four words are here", base, base, " ".join(near), base.upper(), text(40) + " " + passage, passage + "\n" + text(30), text(20) + "\n" + passage + " " + text(10), "be " * 300, "be " * 260 + "end", text(5000), "日本語 ñandú <|endoftext|> it's", "x" * 5000]
    for _ in range(12):
        out.append(text(r.randint(1, 150)))
    return out


@pytest.fixture(scope="session")
def rows():
    return [(i, t, None if i % 5 == 0 else "en", "src", None, 1, 2, 3, 4, 0.5, 1, b"", True) for i, t in enumerate(made_texts())]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Documents with extra columns whose names clash with what operators use inside."""
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
