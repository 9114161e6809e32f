import re
from collections import Counter
from zlib import crc32

from newsloom.llm import variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute(rows):
    """The contract, word by word, with every pair of words compared."""
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long = sorted((a, b), key=len)
        return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    out = {}
    for w, n in words.items():
        others = [o for o in words if near(w, o)]
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form = best if best is not None and words[best] >= 10 * n else None
        out[w] = (form, n, len(others), words[form] if form else None)
    roots = {}
    for w in out:
        r = w
        while out[r][0] is not None:
            r = out[r][0]
        roots[w] = r
    return {w: (f, roots[w], n, k, fn) for w, (f, n, k, fn) in out.items()}


def fixture():
    rows, i = [], 0
    common = ["keyboard", "mountains", "éléphant", "sunflower", "Ørestaden"]
    for word in common:
        for _ in range(25):
            rows.append((i, f"The {word} and the {word.upper()} stay, {word}!"))
            i += 1
    for bad in ["keybaord", "keybord", "keyboards", "mountain", "mountaims", "élephant", "sunflowr", "ørestaden", "sunflowers"]:
        rows += [(i, f"{bad} {bad}"), (i + 1, bad)]
        i += 2
    rows += [(None, "sunflowr keyboard"), (None, None), (7, ""), (8, "x" * 3000 + " " + "x" * 3000), (9, "ab" * 2000 + " " + "ab" * 2000)]
    return rows


def test_equals_brute_force(spark):
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.spelling_variants(docs).collect()}
    want = brute(rows)
    assert got == want
    assert any(f for f, *_ in want.values()) and any(k > 1 for *_, k, _ in want.values())


def test_hard_rows_and_clashing_columns(spark, hard_docs, hard_rows):
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.spelling_variants(hard_docs).collect()}
    assert got == brute(hard_rows)


def test_no_rows(no_docs):
    assert variants.spelling_variants(no_docs).count() == 0


def test_edit_hashes_equal_hashes_of_the_edits():
    import numpy as np

    words = ["abcdefgh", "zzzzzzzz", "éléphant"]
    codes = variants._codes(words, 8)
    deletions, replacements = variants.edit_hashes(codes)
    for r, w in enumerate(words):
        for p in range(8):
            cut = w[:p] + w[p + 1 :]
            assert deletions[r, p] == variants.word_hashes(variants._codes([cut], 7))[0]
            for k, letter in enumerate(variants.LETTERS[:30:7]):
                k = int(np.nonzero(variants.LETTERS == letter)[0][0])
                swapped = w[:p] + chr(int(letter)) + w[p + 1 :]
                assert replacements[r, p, k] == variants.word_hashes(variants._codes([swapped], 8))[0]


def test_bloom_filter_has_no_false_negatives():
    import numpy as np

    hashes = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    blocks = variants.blocks_for(len(hashes), 12)
    filt = np.zeros(blocks * variants.BLOCK_WORDS, np.uint64)
    block, bits = variants._places(hashes, blocks)
    for b, row in zip(block, bits):
        for bit in row:
            filt[b * 8 + (bit >> 6)] |= np.uint64(1) << np.uint64(bit & 63)
    assert variants.probe(filt, hashes).all()
    other = np.random.default_rng(2).integers(0, 2**63, 20000).astype(np.uint64)
    assert variants.probe(filt, other).mean() < 0.05
