"""Small tables with the odd cases that every operator must take."""

import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, text_sha256 string, key string"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def odd_documents() -> list[tuple]:
    """Nulls, empty and long texts, copies, near copies, repeated rows, all kinds of characters."""
    rng = random.Random(7)
    base = sentence(rng, 300)
    texts = [None, "", " ", "a", "A\tb\nC", "12 345", "...", "É" * 5 + " ẞ ΣΑΣ İ", "x" * 5000, "\U0001f600 emoji   nbsp   sep", "<|endoftext|> and <|startoftext|>x", base, base, base + " end", sentence(rng, 40_000)]
    texts += [base.replace(base.split()[k], "changed", 1) for k in (3, 100, 250)]
    texts += ["mail bob@mail.example.com now", "ip 10.0.0.255 and 10.0.0.256", "card 4539 1488 0343 6467 ok", "call +1 (978) 555-2485 soon", "1.2.3.4.5.6.7.8", "+" * 50 + "1" * 5000, "a@b.c+d@e.f a@b", "٣٤"]
    texts += [sentence(rng, rng.randrange(1, 60)) for _ in range(40)]
    rows = [(k, t, ("en", "de", None)[k % 3], f"s{k % 2}", None, 1, "x", "y") for k, t in enumerate(texts)]
    rows += [rows[11], rows[11], (None, base, None, None, None, None, None, None), (None, None, "en", None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
