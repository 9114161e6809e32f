import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from newsloom.llm import suffixes


def expected(rows, least, first_stays=False):
    """What is left of every text, by counting all its strings."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    raw = [(t or "").encode() for _, t in order]
    count = Counter(b[i : i + least] for b in raw for i in range(len(b) - least + 1))
    seen, out = set(), []
    for (doc_id, _), b in zip(order, raw):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - least + 1):
            s = b[i : i + least]
            if (s in seen) if first_stays else count[s] > 1:
                gone[i : i + least] = True
            seen.add(s)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out.append((doc_id, len(b), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum() + gone[0]), sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(docs, least, first_stays=False):
    rows = suffixes.repeat_digests(suffixes.remove_repeats(docs, least, first_stays)).collect()
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("least", [400, 40])
def test_equals_counting(hard_docs, hard_rows, least):
    assert found(hard_docs, least) == expected(hard_rows, least)


def planted(seed):
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choice("abcd é\n") for _ in range(n))
    passages = [say(n) for n in (30, 39, 40, 41, 90, 200)]
    rows = [(i, say(rng.randint(0, 60)) + rng.choice(passages) + say(rng.randint(0, 30)) + rng.choice(passages)) for i in range(80)]
    return rows + [(100 + i, "ab" * (15 + i)) for i in range(12)]


@pytest.mark.parametrize("first_stays", [False, True])
def test_crowded_anchors(spark, monkeypatch, first_stays):
    """Anchors with more surroundings than a group may hold are split, down to single strings."""
    monkeypatch.setattr(suffixes, "GROUP_REGIONS", 3)
    monkeypatch.setattr(suffixes, "BUCKET_REGIONS", 10)
    rows = planted(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(docs, 40, first_stays) == expected(rows, 40, first_stays)


def test_first_stays(spark):
    rows = planted(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(docs, 40, True) == expected(rows, 40, True)


def test_suffix_order():
    texts = [b"banana" * 3, b"nanaban" * 2]
    starts = [np.arange(8), np.arange(4)]
    order, ranks = suffixes.suffix_order(texts, starts, 10)
    joined = b"".join(texts)
    places = np.concatenate([starts[0], starts[1] + len(texts[0])])
    strings = [joined[p : p + 10] for p in places[order]]
    assert strings == sorted(strings)
    assert [a == b for a, b in zip(strings, strings[1:])] == (ranks[1:] == ranks[:-1]).tolist()


def test_columns_stay(hard_docs, hard_rows):
    cleaned = suffixes.without_repeats(hard_docs, 200)
    assert cleaned.columns == hard_docs.columns
    rows = cleaned.collect()
    assert sorted(repr(r.doc_id) for r in rows) == sorted(repr(i) for i, _ in hard_rows)
    assert sum(r.text is None for r in rows) == sum(t is None for _, t in hard_rows)


def test_no_rows(no_docs):
    assert found(no_docs, 400) == []
    assert suffixes.without_repeats(no_docs, 40).count() == 0


def test_repeated_rows_without_id_keep_their_first_passage(spark):
    rng = np.random.default_rng(6)
    say = lambda n: "".join(rng.choice(list("abcdefghij "), n))
    passage = say(300)
    first, later = say(150) + passage + say(150), say(150) + passage + say(150)
    rows = [(None, first), (None, first), (5, later)]
    cleaned = suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 240).collect()
    assert [r.text for r in cleaned if r.doc_id is None] == [first, first]
    assert all(len(r.text) < len(later) - 250 for r in cleaned if r.doc_id == 5)


def forged(prefix: str, target: int) -> str:
    """The prefix and eight letters of @..O whose crc32 is ``target`` (crc32 is affine in their low bits)."""
    from zlib import crc32

    def crc(bits: int) -> int:
        return crc32((prefix + "".join(chr(0x40 + ((bits >> (4 * k)) & 15)) for k in range(8))).encode())

    base = crc(0)
    basis = []
    for i in range(32):
        v, m = crc(1 << i) ^ base, 1 << i
        for w, n in basis:
            if v ^ w < v:
                v, m = v ^ w, m ^ n
        if v:
            basis = sorted([*basis, (v, m)], reverse=True)
    want, x = target ^ base, 0
    for w, n in basis:
        if want ^ w < want:
            want, x = want ^ w, x ^ n
    assert want == 0
    return prefix + "".join(chr(0x40 + ((x >> (4 * k)) & 15)) for k in range(8))


def test_rows_with_one_id_and_one_crc32_are_told_apart(spark):
    """Two null-id rows whose texts share a crc32: the clean one loses nothing."""
    import random
    from zlib import crc32

    rng = random.Random(6)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(150))
    dirty = passage + " x " + passage
    clean = forged("".join(rng.choice("qrstuvwxyz ") for _ in range(300)), crc32(dirty.encode()))
    assert crc32(clean.encode()) == crc32(dirty.encode())
    docs = spark.createDataFrame([(None, dirty), (None, clean)], "doc_id long, text string")
    rows = suffixes.repeat_digests(suffixes.remove_repeats(docs)).collect()
    assert sorted(r.n_spans for r in rows) == [0, 2]
