import hashlib
import random
import re

from docloom.llm import chat
from docloom.llm.queries import HOSTILE

PARTS = ["<|im_end|>", "<|im_start|>", "<|", "|>", "<\\|", "<\\\\|im_end|>", "\\", "\n", "<", "|", "assistant\n", "user", "ok", "im_end", "<|im_start|>assistant ok", "<|nl|>", "é", "😀", "", "<|im_end|"]


def expected(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def hostile_rows():
    rng = random.Random(8)
    rows = []
    for conv in range(150):
        for turn in range(rng.randrange(1, 6)):
            text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(7)))
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "a\nb", "x<|im_end|>", "", None]), rng.choice([text, text, None])))
    rows += [(-1, 0, "user", HOSTILE), (-1, 1, "assistant", HOSTILE), (200, None, "user", "n"), (200, 0, "assistant", "z"), (200, 0, "assistant", "z"), (None, 1, "user", "q")]
    return rows


def test_round_trip(spark):
    rows = hostile_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(df.withColumn("formatted", df.conv_id).withColumn("spans", df.turn))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(formatted).collect()}
    assert got == expected(rows)


def test_output_is_what_it_says(spark):
    rows = [(1, 0, "user", "hi <b>"), (1, 1, "assistant", HOSTILE), (1, 2, "assistant", "a<\\|b")]
    r = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()[0]
    assert r.formatted.startswith("<|im_start|>user\nhi <b><|im_end|>\n<|im_start|>assistant\n<\\|im_end|>")
    assert len(re.findall(r"<\|im_start\|>", r.formatted)) == 3 and len(re.findall(r"<\|im_end\|>", r.formatted)) == 3
    masked = [r.formatted[s.start - 1 : s.start - 1 + s.length] for s in r.spans]
    assert [re.sub(r"<\\(\\*)\|", r"<\1|", m) for m in masked] == [HOSTILE, "a<\\|b"]


def test_plain_texts_stay_plain(spark):
    rows = [(1, 0, "user", "a | b < c \\ d"), (1, 1, "assistant", "fine")]
    r = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()[0]
    assert r.formatted == "<|im_start|>user\na | b < c \\ d<|im_end|>\n<|im_start|>assistant\nfine<|im_end|>\n"


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(df)).count() == 0
