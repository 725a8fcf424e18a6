import random

import pytest

#: Names that operators use inside, as columns of the input.
CLASHING = ("tid", "rank", "n", "node", "part", "sid", "tokens", "key", "spans", "score", "component", "bucket", "kind", "length")


def corpus():
    """Small texts with copies, near copies, shared passages, junk, nulls, empty and long ones, and repeated rows."""
    rng = random.Random(5)
    words = ["the", "of", "and", "stone", "river", "Bridge", "éclair", "moon", "a", "in", "Über", "quiet", "lamp", "seven", "glass", "north", "winter", "paper", "slow", "tide"]
    say = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) * (rng.random() < 0.6) for _ in range(n))
    base, passage = say(120), say(60)
    near = base.split()
    near[10], near[90] = "other", "things"
    texts = [base, base, " ".join(near), base.upper(), passage + "\n" + say(30), say(20) + " " + passage, say(25) + " " + passage + " " + say(12), None, "", "", " \t\n", "one", "one", "two words", "four words are here", "Four words are here"]
    texts += ["x y " * 300, "aaa " * 500, "é" * 450, "ab" * 300, say(15), say(4000)]
    texts += [say(rng.randrange(5, 80)) for _ in range(12)]
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts)]
    rows += [rows[0], (None, say(30)), (None, base), (7, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    cols = ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(i, t, None, "src", 0, *(["z"] * len(CLASHING))) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {cols}")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
