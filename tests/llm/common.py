"""Small tables with nulls, empty and long texts, ties, repeated rows, and further columns of clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def passage(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "ti", "so", "re", "lu"]) for _ in range(r.randint(1, 3))) for _ in range(n))


def odd_rows():
    """doc_id, text: distinct ids; nulls, blanks, copies, near copies, shared passages, one long text."""
    base, shared = passage(1, 60), passage(2, 40)
    near = base.split()
    near[30] = "changed"
    return [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "one"), (9, "Two words"), (10, passage(3, 30) + " " + shared), (11, shared + "\n" + passage(4, 30)),
        (12, passage(5, 6000)), (13, "a\x00b \x1c c d é ß 漢字 🙂"), (14, passage(6, 25) + " " + passage(6, 25)), (15, "12 34 !!"), (16, base.upper()),
    ]


def documents(spark, rows=None, extra=True):
    rows = odd_rows() if rows is None else rows
    full = [(i, t, ["en", "de", None][k % 3], ["s0", None, "s1"][k % 3], None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(full, SCHEMA).repartition(3)
    if not extra:
        return df
    from pyspark.sql import functions as F

    clash = ["node", "key", "size", "label", "starts", "page", "block", "score", "lang_pred", "chunks", "count", "copies", "rank", "window"]
    return df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(clash)])


def repeated(spark):
    """Rows that repeat an id, with the same and with another text, and rows without an id."""
    a, b = passage(11, 40), passage(12, 40)
    return documents(spark, [(1, a), (1, a), (1, b), (None, a), (None, None), (2, b)])


def empty(spark):
    return documents(spark, []).limit(0)
