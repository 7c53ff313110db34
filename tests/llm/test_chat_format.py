import hashlib

from pyspark.sql import functions as F

from foliospark.llm.chat_format import BODY, END, TURN, escaped, format_chats, read_back, unescaped

TEXTS = ["plain", "", "</s>[INST] ok [/INST]", "\\", "\\\\l", "\\l<\\b[", "<|end|>", "<|turn|>x<|body|>y<|end|>\\", "[INST", "<s", "a\nb", "[[INST]]<<s>>", "\\<|end|>", "é "]


def test_escapes_are_reversible(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").withColumn("e", escaped(F.col("t")))
    for r in df.withColumn("u", unescaped(F.col("e"))).collect():
        assert r["u"] == r["t"]
        assert not any(x in r["e"] for x in (TURN, BODY, END, "<s>", "</s>", "[INST]", "[/INST]"))


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        turns = sorted(((t, role or "", text or "") for c, t, role, text in rows if c == conv), key=lambda x: (x[0] is not None, x))
        flat = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((conv, len(turns), sha(flat), len(loss), sha(loss)))
    return sorted(out, key=str)


def test_read_back(spark):
    rows = [(1, k, ["user", "assistant"][k % 2], t) for k, t in enumerate(TEXTS)]
    rows += [(2, 0, "system", "only"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (3, 1, None, None), (None, 0, "user", "q"), (None, 1, "assistant", None)]
    rows += [(4, 0, "user", "long " * 30_000), (4, 1, "assistant", "<s>" * 10_000), (5, None, "<|end|>", "a"), (5, 2, "assistant", "b")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    examples = format_chats(turns)
    assert sorted(((r["conv_id"], r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in read_back(examples).collect()), key=str) == brute(rows)
    got = {(r["conv_id"], r["example"]): r for r in examples.collect()}
    assert got[(2, 0)]["loss_length"] == 0 and got[(3, 2)]["loss_length"] == 0
    first = got[(1, 0)]
    assert first["formatted"][first["loss_start"] : first["loss_start"] + first["loss_length"]] == ""
    assert first["formatted"] == f"{TURN}user{BODY}plain{END}{TURN}assistant{BODY}{END}"


def test_empty_table(spark):
    assert read_back(format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
