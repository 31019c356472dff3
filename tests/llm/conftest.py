import random

import pytest

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, blank, long, repeated and tied rows; near copies; extra columns whose names operators use themselves."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghinorstué") for _ in range(rng.randint(2, 9))) for _ in range(600)]
    base = [" ".join(rng.choices(vocab, k=n)) for n in (3, 5, 9, 12, 40, 60, 120, 400)]
    texts = [*base, None, "", "  \n ", LONG, base[4], base[4], "One Two three", "one two THREE"]
    for t in base[5:]:
        w = t.split()
        for share in (0.02, 0.04, 0.1, 0.3):
            v = list(w)
            for i in rng.sample(range(len(v)), max(1, int(share * len(v) / 5))):
                v[i] = rng.choice(vocab) + "Q"
            texts.append(" ".join(v))
    rows = [(i, t, "en", "key") for i, t in enumerate(texts)]
    rows += [(3, base[3], "en", "again"), (None, base[6], None, None), (None, None, None, None)]
    return spark.createDataFrame(
        [(i, t, lang, "src", None if t is None else len(t), k, 1, 2.0, "s") for i, t, lang, k in rows],
        "doc_id long, text string, lang string, source string, n_chars long, key string, rank int, score double, m string",
    )


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")


@pytest.fixture(scope="session")
def odd_pairs(odd_docs):
    return [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
