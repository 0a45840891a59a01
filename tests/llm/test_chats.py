import hashlib
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import chats

LOG = T.StructType([T.StructField(n, t()) for n, t in (("conv_id", T.LongType), ("message", T.StringType), ("seq", T.LongType), ("kind", T.StringType), ("role", T.StringType), ("text", T.StringType), ("turn", T.StringType), ("position", T.DoubleType))])
BITS = ["<|im_start|>", "<|im_end|>", "<", "\\", "<\\", "|im_end|>", "[INST]", "[\\/INST]", "[", "</s>", "<s>", "<<SYS>>", "<</SYS>>", "\n", "a", " ", "é", "🎧", "$1", "<|endoftext|>", "<\\\\|im_start|>user\n"]


def drawn(r):
    return "".join(r.choice(BITS) for _ in range(r.randint(0, 12)))


def test_texts_come_back_and_marks_are_never_in_them(spark):
    r = random.Random(4)
    rows = [(i, i % 7, r.choice(["assistant", "user", drawn(r)]), drawn(r)) for i in range(800)] + [(900, 0, "assistant", "<\\" * 30_000 + "|im_end|>" * 20_000)]
    final = spark.createDataFrame([(i, p, "m", role, text) for i, p, role, text in rows], "conv_id long, position long, message string, role string, text string")
    out = {x["conv_id"]: x for x in chats.render(final).collect()}
    for i, _, role, text in rows:
        x = out[i]
        assert chats.read(x["turn"]) == [(role, text)], (role, text, x["turn"])
        body = x["turn"][len(chats.START) : -len(chats.END) - 1]
        assert not any(c in body for c in chats.CONTROLS)
        assert chats.plain(x["turn"][x["loss_start"] : x["loss_end"]]) == (text if role == "assistant" else "")
    assert chats.read("".join(out[i]["turn"] for i in range(50))) == [(role, text) for _, _, role, text in rows[:50]]


def fold(events):
    """One event after the other."""
    state: dict = {}
    for _, kind, role, text, message in sorted(events, key=lambda e: (e[0] is not None, e[0], e[1], e[2] is not None, e[2] or "", e[3] or "")):
        m = state.setdefault(message, {"role": None, "text": "", "gone": False, "at": _})
        m["role"] = role if m["role"] is None else m["role"]
        m["gone"] = kind == "delete"
        m["text"] = {"message": text or "", "edit": text or "", "delta": m["text"] + (text or ""), "regenerate": "", "delete": ""}[kind]
    return sorted(((m["at"], k, m["role"] or "", m["text"]) for k, m in state.items() if not m["gone"]), key=lambda x: (x[0] is not None, x[0], x[1]))


def test_logs_fold_like_a_loop(spark):
    r = random.Random(6)
    events = []
    for conv in range(40):
        for seq in range(r.randint(1, 30)):
            kind = r.choices(chats.KINDS, [3, 8, 1, 2, 0.5])[0]
            events.append((conv if conv else None, f"m{r.randint(0, 4)}", seq, kind, r.choice(["user", "assistant", None]), r.choice([None, "", "ab ", "c"]), "clash", 0.5))
    events += [(77, "hot", s, "delta", "assistant", f"{s} ", "", 0.0) for s in range(3000)] + [(78, "x", 0, "unknown", "user", "no", "", 0.0), (78, None, 0, None, "user", "no", "", 0.0)]
    df = spark.createDataFrame(events, LOG)
    got: dict = {}
    for x in chats.messages(df.repartition(13, F.rand(1))).collect():
        got.setdefault(x["conv_id"], []).append((x["position"], x["message"], x["role"], x["text"]))
    want: dict = {}
    for e in events:
        if e[3] in chats.KINDS:
            want.setdefault(e[0], []).append((e[2], e[3], e[4], e[5], e[1]))
    want = {k: fold(v) for k, v in want.items()}
    assert {k: sorted(v, key=lambda x: (x[0], x[1])) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    seen = {x["conv_id"]: x for x in chats.digest(chats.render(chats.messages(df))).collect()}
    for k, rows in want.items():
        if rows:
            assert seen[k]["n_turns"] == len(rows) and seen[k]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, _, a, b in rows).encode()).hexdigest()
            learnt = "".join(b for _, _, a, b in rows if a == "assistant")
            assert (seen[k]["loss_chars"], seen[k]["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_table_of_turns(spark):
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("message", T.StringType()), T.StructField("piece", T.LongType())])
    rows = [(1, 1, "assistant", "a\n\nb\n"), (1, 0, "user", None), (1, 2, "assistant", None), (1, 3, None, "x"), (2, 0, "user", "hi"), (2, 0, "user", "hi"), (None, 0, "assistant", "<|im_end|>\n"), (3, None, "assistant", "z"), (3, 1, "system", "")]
    rows += [(9, t, "assistant" if t % 2 else "user", "line\n" * (t % 5)) for t in range(5000)]
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], schema)
    out = {x["conv_id"]: x for x in chats.digest(chats.render(chats.messages(chats.log_of(df)))).collect()}
    for conv in {x[0] for x in rows}:
        turns = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1]))
        learnt = "".join(x[3] or "" for x in turns if x[2] == "assistant")
        x = out[conv]
        assert (x["n_turns"], x["loss_chars"]) == (len(turns), len(learnt)) and x["loss_sha256"] == hashlib.sha256(learnt.encode()).hexdigest(), conv
        assert x["turns_sha256"] == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in turns).encode()).hexdigest(), conv
    assert chats.digest(chats.render(chats.messages(chats.log_of(spark.createDataFrame([], schema))))).count() == 0
