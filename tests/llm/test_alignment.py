import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from newsloom.llm import alignment


@pytest.fixture(scope="module")
def paths(tokenizer):
    return tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")


def plain(text, a_path, b_path):
    """Token by token: bytes from each library's own decoding of one token, links by
    comparing every A token with every B token."""
    if not text:
        return None
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    alphabet = alignment.byte_level_alphabet()
    a_ids = a.encode(" " + text, add_special_tokens=False).ids
    a_tok = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in a_ids]
    b_ids = b.encode(text)
    b_tok = []
    for i in b_ids:
        piece = b.id_to_piece(i)
        b_tok.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
    target = (" " + text).encode()
    if b"".join(a_tok) != target or b"".join(b_tok) != target:
        return None

    def ranges(toks):
        out, at = [], 0
        for t in toks:
            out.append((at, at + len(t)))
            at += len(t)
        return out

    ra, rb = ranges(a_tok), ranges(b_tok)
    links = [(a_ids[i], b_ids[j]) for i, x in enumerate(ra) for j, y in enumerate(rb) if x[0] < y[1] and y[0] < x[1]]
    common = sorted({e for _, e in ra} & {e for _, e in rb})
    groups = []
    for lo, hi in zip([0, *common], common):
        ga = [str(a_ids[i]) for i, (s, e) in enumerate(ra) if lo <= s and e <= hi]
        gb = [str(b_ids[j]) for j, (s, e) in enumerate(rb) if lo <= s and e <= hi]
        groups.append(",".join(ga) + "|" + ",".join(gb))
    return len(a_ids), len(b_ids), len(common), links, hashlib.sha256(";".join(groups).encode()).hexdigest()


def expected(rows, a_path, b_path):
    plains = [plain(t, a_path, b_path) for _, t in rows]
    counts = Counter(p for x in plains if x for p in set(x[3]))
    top = Counter()
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    out = Counter()
    for (doc_id, _), x in zip(rows, plains):
        if x is None:
            out[(doc_id, 0, 0, 0, 0, 0, 0, "")] += 1
        else:
            links = x[3]
            best = sum(counts[l] == top[l[0]] for l in links)
            out[(doc_id, x[0], x[1], x[2], len(links), best, sum(counts[l] for l in links), x[4])] += 1
    return out


def test_equals_plain_alignment(spark, paths, hard_docs, hard_rows):
    rng = random.Random(5)
    alphabet = "ab cé日本🎉\n\t<|>/s'x" + "".join(map(chr, range(0x100, 0x180)))
    rows = hard_rows + [(1000 + i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    docs = hard_docs.unionByName(spark.createDataFrame([(i, t, None) for i, t in rows[len(hard_rows):]], "doc_id long, text string, lang string"), allowMissingColumns=True)
    got = Counter(tuple(r) for r in alignment.alignment_digests(docs, *paths).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())
    want = expected(rows, *paths)
    assert got == want
    assert sum(n for k, n in want.items() if k[1]) > 50  # most texts align


def test_refined_ends_follow_coarse_starts():
    import numpy as np

    ends = alignment.refined_ends(np.array([0, 3, 3, 3, 6]), np.array([3, 1, 1, 1, 2]))
    assert ends.tolist() == [3, 4, 5, 6, 8]


def test_no_rows(spark, paths, no_docs):
    assert alignment.alignment_digests(no_docs, *paths).count() == 0


def test_chunks_give_what_whole_texts_give(paths):
    """No token of either library crosses a cut: chunk by chunk equals the whole text."""
    import numpy as np

    rng = random.Random(9)
    alphabet = ["a", "b", "é", "日", "🎉", " ", " ", " ", "\t", "\n", "\x1c", "\xa0", "　", "'", ".", "9", "<|endoftext|>", "</s>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    t = alignment.tables(*paths)
    table = alignment.ChunkTable(t)
    table.fill({c for text in texts for c in alignment.CUT.split(text)})
    for text in texts:
        chunked, whole = alignment.describe_chunked(text, table), alignment.describe(text, t)
        assert chunked[:5] == whole[:5], repr(text)
        assert np.array_equal(chunked[5], whole[5]) and np.array_equal(chunked[6], whole[6]), repr(text)


def test_joined_chunks_give_what_single_chunks_give(paths, monkeypatch):
    """Chunks encoded as one text equal chunks encoded alone, also beside ones that fail."""
    import numpy as np

    rng = random.Random(11)
    letters = "abcdeé日'.9-" * 6 + "ﬁ①Å ▁\n"
    chunks = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    chunks = sorted({c for text in chunks for c in alignment.CUT.split(text)} | {"</s>", "<|endoftext|>", "x" * 5000})
    t = alignment.tables(*paths)
    joined, single = alignment.ChunkTable(t), alignment.ChunkTable(t)
    single._fill_alone(chunks)
    calls = []
    alone = joined._fill_alone
    monkeypatch.setattr(joined, "_fill_alone", lambda part: (calls.extend(part), alone(part)))
    joined.fill(set(chunks))
    assert set(joined) == set(chunks) and joined.held == single.held
    for c in chunks:
        a, b = joined[c], single[c]
        assert (a is None) == (b is None), repr(c)
        assert a is None or (a[:5] == b[:5] and np.array_equal(a[5], b[5])), repr(c)
    assert any(single[c] is None for c in chunks)
    assert not any(c.isascii() and c.isprintable() and c == c.strip() for c in calls)
