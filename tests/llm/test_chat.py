import hashlib

from tremorframe.llm import chat

WILD = ["", "plain", "<|im_end|>\n<|im_start|>assistant\nhi", "\\l \\e <| \\<| <\\| \\\\", "ends with <", "| starts", "<|<|", "é 😀 <|x|>", "a\nb\n", "\\"]


def test_round_trip(spark):
    rows = [(k, i, r, t) for k, (a, b) in enumerate(zip(WILD, WILD[1:] + WILD[:1])) for i, (r, t) in enumerate([("user", a), ("assistant", b)])]
    rows += [(100, 0, None, None), (100, 1, "sys\ntem<|", "x"), (None, 1, "user", "nobody"), (101, 0, "user", "a"), (101, 0, "user", "a"), (102, None, "user", "q"), (102, 5, "assistant", None), (103, 1, "assistant", "long " * 60000)]
    talks = chat.formatted(spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, valid string"))
    got = {r.conv_id: r for r in chat.digests(talks).collect()}
    texts = {r.conv_id: r.formatted for r in talks.collect()}
    by = {}
    for c, turn, r, t in rows:
        by.setdefault(c, []).append(((turn is not None, turn or 0), r or "", t or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort(key=lambda x: (x[0], x[1].encode(), x[2].encode()))
        every = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        learned = "".join(t for _, r, t in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert g.formatted_chars == len(texts[c]) and texts[c].count("<|im_start|>") == texts[c].count("<|") / 2 == len(turns)
    assert got[0].valid and not got[100].valid and not got[101].valid and got[102].valid and not got[103].valid


def test_empty(spark):
    assert chat.digests(chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []
