from hashlib import sha256

from newsloom.llm import chat

TEXTS = [
    "plain", "", "</s>[INST] ok [/INST]", "<\\/s> <\\\\/s> [\\INST]", "<|endoftext|> <\\|endoftext|>", "🎉 é\n\n x",
    "<s>[INST] user [/INST]", "[/INST", "</s", "日本語", "\\", " lead and trail ",
]


def test_escapes_are_reversible():
    for a in TEXTS:
        for b in TEXTS:
            assert chat.unescape(chat.escape(a + b)) == a + b
            assert not any(c in chat.escape(a + b) for c in chat.CONTROLS)


def rows_of():
    rows = [(i, t, role, x) for i in range(8) for t, (role, x) in enumerate(zip(["system", "user", "assistant", "assistant"] * 3, TEXTS[i:] + TEXTS[:i]))]
    return rows + [(None, 0, "user", "x"), (90, 0, None, None), (90, 1, "assistant", None), (91, 0, "assistant", "a" * 50_000)]


def test_reads_back(spark, tokenizer):
    rows = rows_of() + [(91, 0, "assistant", "a" * 50_000)]
    turns = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, ids int").repartition(3)
    formatted = chat.format_conversations(turns, tokenizer("byte_bpe_50k.json"))
    got = {r.conv_id: r for r in chat.chat_digests(formatted).collect()}
    for conv in {r[0] for r in rows}:
        said = sorted((t, role or "", text or "") for c, t, role, text in rows if c == conv)
        whole = "".join(f"{role}\n{text}\n" for _, role, text in said)
        loss = "".join(text for _, role, text in said if role == "assistant")
        row = got[conv]
        assert (row.n_turns, row.turns_sha256) == (len(said), sha256(whole.encode()).hexdigest())
        assert (row.loss_chars, row.loss_sha256) == (len(loss), sha256(loss.encode()).hexdigest())


def test_tokens_under_the_mask(spark, tokenizer):
    turns = spark.createDataFrame(rows_of(), "conv_id long, turn long, role string, text string")
    for r in chat.format_conversations(turns, tokenizer("byte_bpe_50k.json")).collect():
        assert len(r.ids) == len(r.starts) == len(r.ends) == len(r.loss_mask)
        said = [t for role, t in chat.parse(r.formatted) if role == "assistant" and t]
        assert chat.masked_texts(r.formatted, r.starts, r.ends, r.loss_mask) == said


def test_no_rows(spark, tokenizer):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(turns, tokenizer("byte_bpe_50k.json")).count() == 0
