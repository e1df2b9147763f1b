import random

import pytest

WORDS = "anat bere coth dun elor fint gare hule isk jom kerr lont mip nusk orr pell quon rast sib tuv".split()


@pytest.fixture(scope="session")
def prose():
    """Random words, the same for the same seed."""
    def make(seed: int, n: int, words=WORDS) -> str:
        r = random.Random(seed)
        return " ".join("".join(r.choice(words) for _ in range(r.randint(1, 2))) for _ in range(n))
    return make


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang), with columns whose names clash with results."""
    def build(rows, clash: bool = True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", None if r[1] is None else len(r[1])) for r in rows]
        frame = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        if not clash:
            return frame
        return frame.selectExpr("*", "'x' as score", "1 as sid", "2 as n", "3 as place", "'y' as ids", "4 as kept", "5 as packer", "6 as shard",
                                "7 as h", "8 as pos", "9 as spans", "10 as rejected", "11 as document_key", "12 as repeated_spans", "13 as row", "14 as doc")
    return build
