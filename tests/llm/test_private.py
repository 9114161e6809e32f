import hashlib
import itertools
import random

import numpy as np

from newsloom.llm import private


def test_gradients_equal_differences():
    net = private.Tagger.new(depth=3, hidden=2, seed=2)
    rng = np.random.default_rng(0)
    for k in net.p:
        net.p[k] = net.p[k] + rng.normal(0, 0.3, net.p[k].shape)
    x = rng.integers(0, 20, (3, 5))
    tags = rng.integers(0, 3, (3, 5))
    _, grads = net.loss_and_grads(x, tags)
    for k in ("embed", "wx_f", "wh_b", "bias_f", "out", "trans", "start", "end"):
        for index in list(np.ndindex(net.p[k].shape))[:6]:
            if k == "embed" and index[0] not in x:
                continue
            keep = net.p[k][index]
            net.p[k][index] = keep + 1e-5
            up = net.loss_and_grads(x, tags)[0]
            net.p[k][index] = keep - 1e-5
            down = net.loss_and_grads(x, tags)[0]
            net.p[k][index] = keep
            assert abs((up - down) / 2e-5 - grads[k][index]) < 1e-6, (k, index)


def test_viterbi_equals_all_sequences():
    net = private.Tagger.new(seed=4)
    rng = np.random.default_rng(1)
    net.p["trans"] = rng.normal(0, 2, (3, 3))
    net.p["start"], net.p["end"] = rng.normal(0, 1, 3), rng.normal(0, 1, 3)
    x = rng.integers(0, 90, (4, private.WIDTH))
    u, _ = net.emissions(x)
    got = net.decode(x)
    for r in range(4):
        def score(seq):
            return net.p["start"][seq[0]] + sum(u[r, t, s] for t, s in enumerate(seq)) + sum(
                net.p["trans"][a, b] for a, b in zip(seq, seq[1:])) + net.p["end"][seq[-1]]
        # brute force over the first 6 places, the rest held at the decoded tags
        best = max(itertools.product(range(3), repeat=6), key=lambda head: score(list(head) + got[r, 6:].tolist()))
        assert list(best) == got[r, :6].tolist()


def test_sure_windows_need_no_viterbi(monkeypatch):
    rng = np.random.default_rng(5)
    net = private.Tagger.new(seed=5)
    net.p["trans"], net.p["start"], net.p["end"] = rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3), rng.normal(0, 1, 3)
    viterbi, asked = net._viterbi, []
    monkeypatch.setattr(net, "_viterbi", lambda u: asked.append(u.shape[2]) or viterbi(u))
    for lead in (0.0, 1.5, 3.0, 6.0):
        net.p["out_bias"] = np.array([lead, 0.0, 0.0])
        u = net._spoken(rng.integers(0, 97, (400, 12)).astype(np.uint8))
        sure = net._outside(u)
        assert not viterbi(u)[sure].any()
    x = rng.integers(0, 97, (400, 12)).astype(np.uint8)
    assert net.decode(x).shape == (400, 12) and sum(asked) < 400
    net.p["out_bias"] = np.array([-9.0, 0.0, 0.0])
    assert net.decode(x).all() and asked[-1] == 400


def test_rules_as_stated():
    text = "mail a.b@x.org, ip 10.0.0.1 and 300.1.1.1, card 4111 1111 1111 1111, bad 4111 1111 1111 1112, call +1 (555) 010-9999 or +12 3"
    spans = private.base_spans(text)
    said = [(private.KINDS[k], text[a:b]) for a, b, k in spans]
    assert said == [("email", "a.b@x.org"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 010-9999")]


def planted(rng, n):
    words = ["the", "report", "was", "sent", "today", "with", "notes", "on", "page", "year", "about", "and"]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    rows = []
    for i in range(n):
        user = "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
        phone = "+{} {} {}-{}".format(rng.randint(1, 99), rng.randint(100, 999), rng.randint(100, 999), rng.randint(1000, 9999))
        rows.append((i, f"{say(5)} {user}@{user[::-1]}.com {say(4)} page {rng.randint(1, 99)} of {rng.randint(1990, 2030)} {say(3)} {phone} {say(4)}"))
    return rows


def test_held_out_tags(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame(planted(rng, 400), "doc_id long, text string")
    net = private.fit_private(docs)
    held = planted(random.Random(99), 60)
    right = total = 0
    for _, text in held:
        base = private.base_spans(text)
        for a, b in private.regions(text):
            for s in private.window_starts(a, b):
                want = private._tags_of(text, s, base)
                got = net.decode(private.codes([text[s : s + private.WIDTH]]))[0]
                n = min(private.WIDTH, len(text) - s)
                right += int((want[:n] == got[:n]).sum())
                total += n
    assert right / total > 0.97


def test_rows_and_digests(spark, hard_docs, hard_rows):
    extra = [(900, "write to x.y@mail.example.org or +44 20 7946 0958"), (901, "card 4111-1111-1111-1111 at 192.168.0.1")]
    docs = hard_docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    net = private.fit_private(docs)
    rows = private.private_digests(private.find_private(docs, net)).collect()
    assert len(rows) == len(hard_rows) + 2
    for r in rows:
        text = dict(hard_rows + extra).get(r.doc_id) if r.doc_id is not None else None
        if r.doc_id in (900, 901):
            base = private.base_spans(text)
            said = ",".join(f"{private.KINDS[k]}:{a}:{b}" for a, b, k in base)
            assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
            assert r.spans.startswith(said)
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in rows}
    assert got[900] == (1, 0, 0, 1) and got[901] == (0, 1, 1, 0)
    assert all(r.spans == "" for r in rows if r.doc_id in (0, 1))


def test_no_rows(spark, no_docs):
    net = private.fit_private(no_docs)
    assert private.find_private(no_docs, net).count() == 0


def test_texts_are_read_whole():
    """A network that marks everything marks all of a text without a digit or an ``@``."""
    net = private.Tagger.new(seed=1)
    net.p["out"][:] = 0
    net.p["out_bias"][private.I] = 5.0
    texts = ["plain words " * 70, "", "ab", "x" * private.READ]
    assert private.find_in(texts, net) == [[(0, len(t), 4)] if t else [] for t in texts]


def test_the_most_central_window_decides(monkeypatch):
    monkeypatch.setattr(private, "READ", 12)
    monkeypatch.setattr(private, "READ_STEP", 7)
    net = private.Tagger.new(seed=5)
    net.p["trans"] = np.random.default_rng(6).normal(0, 2, (3, 3))
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab 1@é日.") for _ in range(n)) for n in (1, 11, 12, 13, 20, 57, 300)]
    for text, got in zip(texts, private.read_tags(texts, net)):
        want, centre = [None] * len(text), [-1] * len(text)
        for s in private.window_starts(0, len(text), 12, 7):
            part = text[s : s + 12]
            x = np.full((1, 12), len(private.ALPHABET) + 1)
            x[0, : len(part)] = private.codes([part])[0, : len(part)]
            for k, tag in enumerate(net.decode(x)[0, : len(part)].tolist()):
                if min(k, 11 - k) > centre[s + k]:
                    want[s + k], centre[s + k] = tag, min(k, 11 - k)
        assert got.tolist() == want


def test_viterbi_takes_windows_of_many_batches_together(monkeypatch):
    """Few windows of a batch need it; their tags are as if each batch took its own steps."""
    net = private.Tagger.new(seed=2)
    # About every twentieth window is open, whatever batch it is in.
    monkeypatch.setattr(net, "_outside", lambda u: (u[0, 0] * 500).astype(int) % 20 != 0)
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefgh ij") for _ in range(rng.randrange(150, 420))) for _ in range(300)] + ["", "@"]
    alone = [private.read_tags([t], net)[0].tolist() for t in texts]
    monkeypatch.setattr(private, "READ_ROWS", 64)
    viterbi, asked = net._viterbi, []
    monkeypatch.setattr(net, "_viterbi", lambda u: asked.append(u.shape[2]) or viterbi(u))
    assert [t.tolist() for t in private.read_tags(texts, net)] == alone
    batches = -(-sum(len(private.window_starts(0, len(t), private.READ, private.READ_STEP)) for t in texts if t) // 64)
    assert 0 < sum(asked) and len(asked) <= sum(asked) // 64 + 1 < batches
