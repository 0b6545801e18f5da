"""Chat formatting in budgeted windows, with DataFrame functions only.

Every turn is written as ``<turn ROLE>TEXT</turn>`` and a line end. Prefix sums of the turns' tokens, over a conversation
without its system turn, choose the windows: cells of a fixed number of tokens take the turns that lie in them, and a turn
across a cell's end is a window of its own, so no window exceeds its share but that of a single longer turn. Each window
starts with the system turn and, as far as HISTORY tokens go, the turns before it; these are repeated and masked, so each
assistant text is a target once.

Texts are escaped: ``\\`` becomes ``\\0``, ``<`` becomes ``\\1`` and, in roles, ``>`` becomes ``\\2``. As every ``\\`` of an
escaped text is followed by its digit, the steps undo each other in the reverse order, and no ``<`` is left for a mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm._store import settled

#: Tokens of a window and those of them for repeated history; characters that count as a token (an estimate, rounded up for each turn).
BUDGET, HISTORY, CHARS_PER_TOKEN = 1024, 192, 4
#: Turns of a conversation are numbered in blocks of so many turn numbers, and the blocks then put together.
TURN_BLOCK = 256
#: Stands for a null conv_id, which is a conversation too.
NO_ID = -(1 << 63)
TURN = r"(?s)<turn ([^>]*)>([^<]*)</turn>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\0")), F.lit("<"), F.lit("\\1"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\2"), F.lit(">")), F.lit("\\1"), F.lit("<")), F.lit("\\0"), F.lit("\\"))


def marked(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<turn "), F.replace(escaped(role), F.lit(">"), F.lit("\\2")), F.lit(">"), escaped(text), F.lit("</turn>\n"))


def _placed(turns: DataFrame) -> DataFrame:
    """Each turn's place in its conversation (from 1) and the tokens up to its end, without gathering a conversation in a task."""
    order = ["turn", "role", "text"]
    block = turns.withColumn("block", F.floor(F.col("turn") / TURN_BLOCK))
    own = Window.partitionBy("conv", "block").orderBy(*order)
    inside = block.withColumn("place_in", F.row_number().over(own)).withColumn("end_in", F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    totals = block.groupBy("conv", "block").agg(F.count("*").alias("turns"), F.sum("n").alias("tokens"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col("conv").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("turns").over(earlier), F.lit(0)).alias("turns"), F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("tokens"))
    both = inside.join(before, (F.col("conv") == F.col("c")) & F.col("block").eqNullSafe(F.col("b")))
    return both.select("conv", "role", "marked", "n", (F.col("turns") + F.col("place_in")).alias("place"), (F.col("tokens") + F.col("end_in")).alias("end"))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, window, text, n_repeated, loss of every window.

    n_repeated: how many turns at the window's start repeat what earlier windows hold; loss: [start, end) in code points
    of text, one for each assistant text that is a target here, marks left out. Turns go by number, then role and text;
    a null number comes first. Null texts and roles are empty. A null conv_id is a conversation like any other. The
    system turn is the first turn if its role is system. A turn longer than a window is kept whole, alone with what is
    repeated. Repeated rows are turns of their own. An empty table gives no rows. Other columns are not looked at.
    """
    turns = conversations.select(
        F.coalesce(F.col(conv_id).cast("long"), F.lit(NO_ID)).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumn("marked", marked(F.col("role"), F.col("text"))).withColumn("n", F.ceil(F.length("marked") / CHARS_PER_TOKEN))
    placed = settled(_placed(turns), "turns")
    system = placed.filter("place = 1 and role = 'system'").select("conv", F.col("n").alias("system_n"), F.col("marked").alias("system_marked"))
    rest = placed.join(system.select("conv", "system_n"), "conv", "left").withColumn("s", F.coalesce("system_n", F.lit(0))).filter("not (place = 1 and system_n is not null)")
    size = F.greatest(F.lit(budget) - history - F.col("s"), F.lit(1))
    rest = rest.withColumn("start", F.col("end") - F.col("n") - F.col("s")).withColumn("cell", F.floor(F.col("start") / size))
    across = F.floor((F.col("start") + F.col("n") - 1) / size) > F.col("cell")
    fresh = rest.select("conv", (2 * F.col("cell") + across.cast("long")).alias("window"), "place", "role", "marked", "start")
    starts = fresh.groupBy("conv", "window").agg(F.min("start").alias("window_start"))
    item = lambda again: F.struct("place", F.lit(again).alias("again"), "role", "marked")
    parts = fresh.select("conv", "window", item(False).alias("item"))
    if history > 0:
        # turns that start in the ``history`` tokens before a window: its start is in their stretch of so many or the next
        near = starts.withColumn("stretch", F.floor(F.col("window_start") / history))
        earlier = fresh.drop("window").withColumn("stretch", F.explode(F.array(F.floor(F.col("start") / history), F.floor(F.col("start") / history) + 1)))
        again = earlier.join(near, ["conv", "stretch"]).filter((F.col("start") < F.col("window_start")) & (F.col("start") >= F.col("window_start") - history))
        parts = parts.unionByName(again.select("conv", "window", item(True).alias("item")))
    first = system.join(starts, "conv", "left").select(
        "conv", F.coalesce("window", F.lit(0)).alias("window"),
        F.struct(F.lit(0).cast("long").alias("place"), (F.coalesce("window_start", F.lit(0)) > 0).alias("again"), F.lit("system").alias("role"), F.col("system_marked").alias("marked")).alias("item"),
    )
    # a window's turns: bounded by the budget, or one longer turn
    gathered = parts.unionByName(first).groupBy("conv", "window").agg(F.array_sort(F.collect_list("item")).alias("items"))
    head = lambda x: F.instr(x["marked"], ">")  # noqa: E731  code points before the text
    spans = F.aggregate(
        "items",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss")),
        lambda state, x: F.struct(
            (state["at"] + F.length(x["marked"])).alias("at"),
            F.when(
                ~x["again"] & (x["role"] == "assistant"),
                F.concat(state["loss"], F.array(F.struct((state["at"] + head(x)).alias("start"), (state["at"] + F.length(x["marked"]) - len("</turn>\n")).alias("end")))),
            ).otherwise(state["loss"]).alias("loss"),
        ),
    )["loss"]
    return gathered.select(
        F.when(F.col("conv") != NO_ID, F.col("conv")).alias("conv_id"), "window",
        F.array_join(F.transform("items", lambda x: x["marked"]), "").alias("text"),
        F.size(F.filter("items", lambda x: x["again"])).alias("n_repeated"), spans.alias("loss"),
    )


def read_turns(formatted: DataFrame) -> DataFrame:
    """(conv_id, window, position, role, text) of each turn once, parsed from the windows' texts."""
    roles, texts = F.regexp_extract_all("text", F.lit(TURN), F.lit(1)), F.regexp_extract_all("text", F.lit(TURN), F.lit(2))
    found = formatted.select("conv_id", "window", "n_repeated", F.posexplode(F.arrays_zip(roles.alias("r"), texts.alias("t"))).alias("position", "x"))
    return found.filter("position >= n_repeated").select("conv_id", "window", "position", unescaped(F.col("x.r")).alias("role"), unescaped(F.col("x.t")).alias("text"))


def digests(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, from its windows alone.

    A digest runs over a whole conversation, so its turns do meet in one row here; windows() itself never gathers them.
    """
    kept = settled(formatted, "windows")
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["t"]), "")
    turns = read_turns(kept).groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), F.sha2(joined(F.struct("window", "position", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("t"))), 256).alias("turns_sha256")
    )
    texts = F.transform("loss", lambda x: F.struct("window", x["start"].alias("start"), unescaped(F.substr(F.col("text"), x["start"] + 1, x["end"] - x["start"])).alias("t")))
    loss = F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list(texts))), lambda x: x["t"]), "")
    targets = kept.groupBy("conv_id").agg(loss.alias("loss_text"), F.sum(F.length("text")).alias("formatted_chars"))
    return turns.join(targets.withColumnRenamed("conv_id", "id"), F.col("conv_id").eqNullSafe(F.col("id"))).select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars"
    )


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "\\### Assistant: </turn> ok"
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    return digests(windows(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(added)))


OP3_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (SELECT *, length('<turn ></turn>' || chr(10)) + length(role) + length(text)
    + length(regexp_replace(role, '[^\\<>]', '', 'g')) + length(regexp_replace(text, '[^\\<]', '', 'g')) AS chars FROM turns),
numbered AS (SELECT *, (chars + 3) // 4 AS n, row_number() OVER w AS place, sum((chars + 3) // 4) OVER w AS up_to FROM sized
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
systems AS (SELECT conv_id, n AS system_n, chars AS system_chars FROM numbered WHERE place = 1 AND role = 'system'),
rest AS (SELECT t.*, up_to - n - coalesce(system_n, 0) AS start, greatest(1024 - 192 - coalesce(system_n, 0), 1) AS size
  FROM numbered t LEFT JOIN systems s USING (conv_id) WHERE NOT (place = 1 AND system_n IS NOT NULL)),
fresh AS (SELECT *, (start // size) * 2 + CASE WHEN (start + n - 1) // size > start // size THEN 1 ELSE 0 END AS win FROM rest),
starts AS (SELECT conv_id, win, min(start) AS win_start FROM fresh GROUP BY ALL),
chars AS (
  SELECT conv_id, chars FROM fresh
  UNION ALL SELECT f.conv_id, f.chars FROM fresh f JOIN starts s ON f.conv_id = s.conv_id AND f.start < s.win_start AND f.start >= s.win_start - 192
  UNION ALL SELECT y.conv_id, y.system_chars FROM systems y LEFT JOIN starts s ON y.conv_id = s.conv_id),
formatted AS (SELECT conv_id, sum(chars)::BIGINT AS formatted_chars FROM chars GROUP BY conv_id),
digested AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS targets FROM numbered GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(targets)::BIGINT AS loss_chars, sha256(targets) AS loss_sha256, formatted_chars FROM digested JOIN formatted USING (conv_id)
"""
