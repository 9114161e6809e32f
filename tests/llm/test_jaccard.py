import random
import tracemalloc

import numpy as np
import pyarrow as pa

from newsloom.llm import jaccard


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def expected(rows):
    """Number of shingles and smallest linked id of every row, by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i) if i is not None and s else i) for i, s in sets), key=repr)


def found(docs):
    rows = jaccard.document_components(jaccard.jaccard_join(docs)).collect()
    return sorted(map(tuple, rows), key=repr)


def test_equals_all_pairs(hard_docs, hard_rows):
    assert found(hard_docs) == expected(hard_rows)


def test_borders_and_chains(spark, monkeypatch):
    """Near copies of all degrees, a common passage, small groups and buckets."""
    monkeypatch.setattr(jaccard, "GROUP_SETS", 2)
    monkeypatch.setattr(jaccard, "FAMILY_SETS", 3)
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    common = [word() for _ in range(25)]
    rows = []
    for _ in range(12):
        words = [word() for _ in range(rng.randint(5, 60))]
        for _ in range(8):
            rows.append((len(rows), " ".join(words)))
            for _ in range(rng.randint(0, 2)):
                words = list(words)
                words[rng.randrange(len(words))] = word()
        rows.append((len(rows), " ".join([*common, *[word() for _ in range(rng.randint(2, 20))]])))
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == expected(rows)


def test_exact_border(spark):
    """Three shared shingles of four are enough, of five not."""
    a = "a b c d e f g"
    rows = [(1, a), (2, a + " h"), (3, "z " + a + " q")]
    got = {i: c for i, _, c in found(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got == {1: 1, 2: 1, 3: 3}


def test_one_of_each(hard_docs, hard_rows):
    kept = jaccard.one_of_each(hard_docs)
    assert kept.columns == hard_docs.columns
    want = [i for i, _, c in expected(hard_rows) if i is None or i == c]
    want.remove(6) if want.count(6) > 1 else None
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(want, key=repr)


def test_no_rows(no_docs):
    assert found(no_docs) == []


def test_one_of_each_decides_rows_of_one_id_apart(spark):
    say = lambda name: " ".join(f"{name}{n}" for n in range(40))
    rows = [(1, say("a")), (2, say("a")), (2, say("b")), (2, say("b")), (2, "two words"), (3, say("b")), (4, say("c")), (4, say("a"))]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(kept.collect()) == sorted([rows[0], rows[2], rows[4], rows[6]])


def test_heads_hold_what_sets_share(spark):
    """Shingles met again, as heads in small arrays: none that two sets share is missing, and few others."""
    rng = random.Random(8)
    lines = [" ".join(rng.choice("abcdefghijkl") * 3 for _ in range(12)) for _ in range(60)]
    rows = [(i, " ".join(rng.sample(lines, 6))) for i in range(120)] + [(500, lines[0]), (501, lines[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    none = np.zeros(0, np.uint64)
    prefixes = jaccard.Prefixes(none, none, 5, 75)
    owners = {}
    for r in jaccard.prefix_rows(docs, prefixes).collect():
        owners.setdefault(r.token % 2**64, []).append((r.set_id, r.short))
    for bits in (8, 11):
        heads = [r.head for r in jaccard.met_again(docs, prefixes, bits).collect()]
        assert len(heads) == len(set(heads))
        shared = {t >> (33 - bits) for t, o in owners.items() if len({s for s, _ in o}) > 1 and any(x for _, x in o)}
        once = {t >> (33 - bits) for t, o in owners.items() if len(o) == 1} - {t >> (33 - bits) for t, o in owners.items() if len(o) > 1}
        assert shared and shared <= set(heads) and not once & set(heads)


def test_prefix_tasks_hold_little():
    """Texts are hashed in small slices, whatever the size of the batch."""
    rng = random.Random(4)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(300)) for _ in range(2_000)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    assert batch.nbytes > 4_000_000
    tracemalloc.start()
    try:
        none = np.zeros(0, np.uint64)
        n = sum(len(tokens) for tokens, _, _ in jaccard.Prefixes(none, none, 5, 75).of(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n > 100_000 and peak < 60_000_000


def test_frequent_shingles_go_last_by_their_beginning():
    """In all sets alike; the counts need no more than four bytes a shingle beside them."""
    text = "a b c d e f g h i"
    of = lambda last, met: [t for t, _, _ in jaccard.Prefixes(last, met, 5, 1).of(iter([pa.RecordBatch.from_pydict({"text": [text]})]))][0]
    none = np.zeros(0, np.uint64)
    plain = of(none, none)
    often = (np.sort(plain)[:2] >> np.uint64(32)).astype(np.uint32)
    assert of(often, np.array([3, 2], np.uint8)).tolist() == np.sort(plain)[[*range(2, len(plain)), 1, 0]].tolist()
