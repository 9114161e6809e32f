from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from tokenizers import Tokenizer

from newsloom.llm import packing


@pytest.fixture
def model(tokenizer):
    return tokenizer("word_bpe_49k.json")


def check(rows, model, pieces, window):
    library = Tokenizer.from_file(model)
    ids = [(i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for i, t in rows]
    # Documents that repeat an id are told apart by their pieces' checksums.
    want, got = defaultdict(int), defaultdict(int)
    for i, x in ids:
        want[i] += len(x)
    known = defaultdict(list)
    for i, x in ids:
        known[i].append(x)
    for p in pieces:
        got[p.doc_id] += p.length
        assert any(
            len(x) == p.doc_tokens and crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32
            for x in known[p.doc_id]
        )
    assert got == want
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
        total += at
    assert padding <= 0.02 * total


def test_every_id_once_and_little_padding(hard_docs, hard_rows, model):
    check(hard_rows, model, packing.pack_documents(hard_docs, model).collect(), 2048)


def test_small_windows(spark, model):
    rows = [(i, "word " * (i * 7 % 23)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check(rows, model, packing.pack_documents(docs, model, 16).collect(), 16)


def test_plan_uses_no_length_twice():
    rng = np.random.default_rng(1)
    histogram = (400 * np.exp(-(((np.arange(65) - 24) / 10) ** 2)) * rng.uniform(0.5, 1, 65)).astype(int)
    histogram[0] = 0
    plan = packing.solve_plan(histogram, 64)
    used = plan.left.copy()
    for lengths, count in plan.combinations:
        assert 0.98 * 64 <= sum(lengths) <= 64
        for n in lengths:
            used[n] += count
    assert used.tolist() == histogram.tolist()
    assert (plan.left * np.arange(65)).sum() < 0.1 * (histogram * np.arange(65)).sum()


def test_lengths_that_find_no_partner_are_left():
    histogram = np.zeros(65, int)
    histogram[40] = 9
    plan = packing.solve_plan(histogram, 64)
    assert plan.combinations == [] and plan.left[40] == 9


def test_no_rows(no_docs, model):
    assert packing.pack_documents(no_docs, model).count() == 0


def test_word_ids_equal_the_library_on_random_texts(model):
    """Chunks of code points up to U+0260, capitals whose lower case lies beyond the
    simple letters among them, give the library's ids."""
    import random

    library = Tokenizer.from_file(model)
    ids = packing.WordIds(model)
    rng = random.Random(4)
    alphabet = [chr(c) for c in range(1, 0x261)] + ["Ə", "Ɛ", "Ʃ", " ", " ", "a", "e"]
    texts = ["Əli, Əhməd.", "(Ɛkwe)", "$Ʃ"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(30_000)]
    for text, got in zip(texts, ids.encode([t.encode() for t in texts])):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == [*want, packing.END_ID], repr(text)
