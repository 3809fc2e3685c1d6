import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus(spark):
    """Copies, near copies, shared passages, hot lines, edges of all kinds: (doc_id, text)."""
    import random

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeéñß") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    line = lambda: prose(rng.randint(3, 15)).capitalize() + "."
    text = lambda k: "\n".join(line() for _ in range(k))
    passage, hot, block = prose(60), line(), text(5)
    docs = [text(rng.randint(1, 12)) for _ in range(60)]
    docs += [docs[0], docs[1], docs[1], docs[2] + " x", docs[3].replace("a", "e", 1), docs[4][5:]]
    docs += [f"{text(2)}\n{hot}\n{text(2)}" for _ in range(20)] + [f"{prose(7)} {passage} {prose(9)}" for _ in range(8)]
    docs += [f"{line()}\n{block}\n{line()}" for _ in range(4)] + [prose(3000), prose(3) * 100, "ab " * 400, "x" * 2000, "x" * 500]
    base = prose(150).split()
    for _ in range(30):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(150)] = rng.choice(words)
        docs.append(" ".join(copy))
    docs += ["", " ", "\n\n\n", "a", "a b", "A  b", "a\tb c", "ÀB c d", "a b c d", None, None, "\x00 y", "one two three four five six seven eight nine ten"]
    return list(enumerate(docs))


@pytest.fixture(scope="session")
def frame(spark, corpus):
    """The corpus with the other columns of documents, and some of names that operators use themselves."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 7 else None, len(t or ""), 1, 2, 3, 4) for i, t in corpus]
    return spark.createDataFrame(rows, SCHEMA + ", th long, start long, key long, n long")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Null and repeated ids, repeated rows, null texts."""
    rows = [(None, "a b c d e f g h"), (None, "a b c d e f g h"), (5, "x y z"), (5, "x y z"), (5, "other words here"), (6, None), (None, None), (7, "")]
    return spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
