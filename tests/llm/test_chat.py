"""Chat windows: exact round trips, budgets, masks."""

import hashlib
import random

from tracelab.llm import chat
from tracelab.llm.common import stage

SCHEMA = "conv_id long, turn int, role string, text string, span int, k string"


def turns():
    draw = random.Random(3)
    say = lambda n: " ".join(draw.choice(["ja", "no", "<|end|>", "<|turn|>user", "%3C", "%", "[INST]", "é漢", "a\nb"]) for _ in range(n))
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", None), (1, 2, "assistant", ""), (2, 0, "user", "hi"), (2, 0, "user", "hi"), (3, None, None, None), (None, 0, "assistant", "lost"), (None, 1, "user", "too")]
    for c in range(10, 16):
        rows += [(c, -1, "system", say(20))] if c % 2 else []
        rows += [(c, k, "user" if k % 2 == 0 else "assistant", say(draw.randrange(1, 200))) for k in range(30)]
    rows += [(20, k, "a\nrole <|end|>", "x" * (4000 if k == 1 else 10)) for k in range(4)]
    return [(*r, 1, "clash") for r in rows]


def order(row):
    _, turn, role, text, *_ = row
    return (turn is not None, turn or 0, role or "", text or "")


def test_round_trip_and_budget(spark):
    rows = turns()
    windows = stage(chat.format_conversations(spark.createDataFrame(rows, SCHEMA), 256, 64), "windows")
    got = {}
    for r in sorted(chat.read_back(windows).collect(), key=lambda r: r.window):
        said, learned = got.setdefault(r.conv_id, ([], []))
        said += [(t.role, t.text) for t in r.turns]
        learned += r.learned
    convs = {}
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, order(r))):
        convs.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    assert set(got) == set(convs)
    for c, said in convs.items():
        assert got[c][0] == said and got[c][1] == [t for r, t in said if r == "assistant"]
    for r in windows.collect():
        parts = r.text.split(chat.END)[:-1]
        assert all(p.startswith(chat.BEGIN) for p in parts) and len(parts) > r.context
        plain = [p.split("\n", 1)[1] for p in parts]
        if len(parts) > r.context + 1:  # more than one new turn
            assert sum(-(-len(chat_bytes(p)) // 4) + 4 for p in plain) <= 256 + 64
        for x in r.loss:
            assert x.start + x.length <= len(r.text)
    assert any(r.context for r in windows.collect())


def chat_bytes(escaped):
    for plain, code in reversed(chat.ESCAPES):
        escaped = escaped.replace(code, plain)
    return escaped.encode()


def test_empty_and_query(spark):
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    out = {r.conv_id: r for r in chat.op7_chat_format(spark, "/root/testdata/sf0.001").collect()}
    probe = out[-1]
    assert probe.n_turns == 2 and probe.loss_chars == len(chat.PROBE) and probe.loss_sha256 == hashlib.sha256(chat.PROBE.encode()).hexdigest()
    assert probe.turns_sha256 == hashlib.sha256(f"user\n{chat.PROBE}\nassistant\n{chat.PROBE}\n".encode()).hexdigest()
