import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, k string, row int, n_words long"


def _corpus():
    """Texts that share passages, exact and near copies, nulls, empty and long ones, repeated rows, and clashing columns."""
    rng = random.Random(5)
    words = [w + x for w in ("ka", "lo", "Mi", "né", "ou", "pi") for x in ("", "ra", "st", "te", "un", "x1", ",", "Ö.")]
    some = lambda n: " ".join(rng.choices(words, k=n))
    shared = [some(n) for n in (60, 75, 120)]
    lines = [some(9) for _ in range(6)]
    texts = [some(rng.choice([1, 3, 20, 80, 200])) for _ in range(60)]
    for i in range(30):
        a, b = some(rng.randint(0, 40)), some(rng.randint(0, 40))
        texts.append(f"{a} {rng.choice(shared)} {b}")
    for i in range(8):
        texts.append("\n".join([some(7), *lines[i % 3 :], some(5)]))
    base = some(400)
    texts += [base, base, base + " end", "start " + base, base.replace("ka ", "KA ", 1), base + " " + base]
    texts += [None, None, "", "", " \t\n", "a", "\x1c x \x85", shared[0], shared[0].upper(), some(6000), "<|endoftext|> odd", "é" * 450, "xy" * 300]
    rows = [(i * 3, t, "en", [None, "a", "b", "b", "b"][i % 5], len(t or ""), 0.5, "k", 1, 7) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[70], (None, some(70), "en", "a", 1, 0.1, "", 0, 0), (None, texts[65], None, "b", 1, None, None, None, None)]


@pytest.fixture(scope="session")
def corpus():
    return _corpus()


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
