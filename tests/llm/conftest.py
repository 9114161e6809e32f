import random

import public_tokenizers
import pytest

LONG = "word " * 8_000 + "x" * 30_000


@pytest.fixture(scope="session")
def tokenizer():
    return public_tokenizers.path


@pytest.fixture(scope="session")
def hard_rows():
    """Texts that break things: null, empty, blank, very long, repeated, near copies, odd characters."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = say(120), say(120)
    near = base.split()
    near[60] = "changed"
    texts = [
        None, "", " ", "\n\t \x0b", LONG, LONG, base, base, " ".join(near), base.upper(), "one two", "One  TWO",
        passage, say(30) + " " + passage + " " + say(30), say(80) + "\n" + passage, passage + " " + passage,
        "▁ ▁▁x  y ", "日本語 テキスト 🎉🎉 ñ\x00 z", "<|endoftext|> it's <s> x' y_9", "a b　c É́ İ ß ſ",
        'token = "11acdfb36bb72224148e6160f674b4be45601bff"', "aaaa" * 300, "aaaa" * 300 + "b",
        *[say(rng.randint(1, 90)) for _ in range(12)],
    ]
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, (6, base), (None, base), (None, None), (-5, say(40))]


@pytest.fixture
def hard_docs(spark, hard_rows):
    """The rows with columns that operators could trip over."""
    schema = "doc_id long, text string, lang string, n long, ids string, key int, bucket string, set_id int, spans string"
    rows = [(i, t, None, 3, "x", None, "b", 1, "s") for i, t in hard_rows]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, n long")
