import hashlib

from pyspark.sql import functions as F

from quire.llm import chat

ROWS = [
    (1, 0, "system", "Be <brief> \\ kind"), (1, 1, "user", "hi </turn>\n<turn assistant>x"), (1, 2, "assistant", "\\1 é🙂"), (1, 3, "user", None), (1, 4, "assistant", ""),
    (2, 0, "system", "alone"), (3, 5, "assistant", "first"), (3, 5, "assistant", "first"), (3, None, "user", "zero"), (None, 0, "user", "q"), (None, 1, "assistant", "a"),
    (4, 0, "user", "w " * 300), *[(4, k, "assistant" if k % 2 else "user", f"turn {k} " + "w " * (k * 7 % 30)) for k in range(1, 40)], (5, 1, None, "no role"), (5, 2, "odd > role", "t"),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1)).withColumn("place", F.lit("x")).repartition(3)


def expected():
    by = {}
    for c, t, r, x in ROWS:
        by.setdefault(c, []).append((t if t is not None else -1, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_read_back(spark):
    for budget, history in ((1024, 192), (60, 20), (10, 0), (1, 5)):
        got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(chat.windows(table(spark), budget, history)).collect()}
        assert got == expected()


def test_windows(spark):
    rows = chat.windows(table(spark), 120, 30).filter("conv_id = 1 or conv_id = 4").collect()
    four = sorted((r for r in rows if r["conv_id"] == 4), key=lambda r: r["window"])
    assert len(four) > 5 and four[0]["n_repeated"] == 0
    turns = [r["text"].count("<turn ") for r in four]
    for r, n in zip(four, turns, strict=True):
        own = n - r["n_repeated"]
        assert own >= 1 and (len(r["text"]) <= 4 * 120 or own == 1)
    assert sum(turns) - sum(r["n_repeated"] for r in four) == 40 and any(r["n_repeated"] for r in four)
    # loss covers assistant texts only
    for r in rows:
        for a, b in r["loss"]:
            before = r["text"][:a]
            assert before.endswith("<turn assistant>") and r["text"][b:].startswith("</turn>\n")


def test_system_turn_stays(spark):
    rows = [(7, 0, "system", "rules"), *[(7, k, "user", "w " * 60) for k in range(1, 9)]]
    found = chat.windows(table(spark, rows), 100, 0).collect()
    assert len(found) > 2 and all(r["text"].startswith("<turn system>rules</turn>\n") for r in found)
    assert sorted(r["n_repeated"] for r in found)[0] == 0 and sum(r["n_repeated"] for r in found) == len(found) - 1


def test_empty(spark):
    assert chat.digests(chat.windows(table(spark).limit(0))).count() == 0


def test_native_plan(spark):
    plan = chat.windows(table(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
