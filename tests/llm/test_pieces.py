from hashlib import sha256

import pytest
from sentencepiece import SentencePieceProcessor

from newsloom.llm import pieces


@pytest.fixture
def model(tokenizer):
    return tokenizer("piece_bpe_32k.model")


def test_equals_the_library(hard_docs, hard_rows, model):
    library = SentencePieceProcessor(model_file=model)
    got = pieces.piece_digests(pieces.decode_pieces(pieces.encode_pieces(hard_docs, model), model)).collect()
    digest = lambda s: sha256(s.encode()).hexdigest()
    want = []
    for doc_id, text in hard_rows:
        ids = library.encode(text or "", num_threads=1)
        want.append((doc_id, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_decodes_any_ids(spark, model):
    library = SentencePieceProcessor(model_file=model)
    lists = [[1, 264, 0, 287], [0], [3, 195], [28705, 28705, 264], [], [264, 2], [5, 6, 264, 264]]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)] + [(99, None)], "i int, ids array<int>")
    got = {r.i: r.decoded for r in pieces.decode_pieces(rows, model).collect()}
    assert got == {**{i: library.decode(x) for i, x in enumerate(lists)}, 99: ""}


def test_a_full_table_starts_anew(hard_docs, model, monkeypatch):
    whole = {(r.doc_id, tuple(r.ids)) for r in pieces.encode_pieces(hard_docs, model).collect()}
    monkeypatch.setattr(pieces, "TABLE_CHUNKS", 3)
    assert {(r.doc_id, tuple(r.ids)) for r in pieces.encode_pieces(hard_docs, model).collect()} == whole


def test_no_rows(no_docs, model):
    assert pieces.decode_pieces(pieces.encode_pieces(no_docs, model), model).count() == 0
