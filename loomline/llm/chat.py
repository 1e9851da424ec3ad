"""Chat formatting into budgeted windows. DataFrame functions only.

Prefix sums of turn tokens cut a conversation into turn-aligned spans: a turn
belongs to the span in whose half budget it starts. A window is the system turn
(if the conversation has one), the last turns of the span before, up to the
history budget, and the turns of its own span. Only assistant turns of the own
span are under the loss mask, so a repeated target is masked.

Template: ``<s>[INST] role [/INST]text</s>`` for each turn. Control strings
inside roles and texts get a backslash after their first character (and one
more if they have some), which is undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .mixing import word_count
from .scratch import table

BUDGET, HISTORY, OVERHEAD = 512, 96, 4  # tokens: of a window, of repeated turns, of a turn's marks
# Control strings of common chat templates without their first character.
RESTS = r"s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|eot_id\|>|\|start_header_id\|>|\|end_header_id\|>"
TURN = r"(?s)<s>\[INST\] (.*?) \[/INST\](.*?)</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({RESTS})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({RESTS})", "$1$2$3")


def turn_tokens(text: Column) -> Column:
    return word_count(text) + OVERHEAD


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, window, context, turns, formatted, loss): formatted windows of every conversation.

    ``context`` turns come first and are repeated; ``turns`` new ones follow;
    ``loss`` holds (start, length) of the escaped assistant texts under the loss
    mask, in code points from 0. A window is at most ``budget`` tokens (words
    and marks) unless one of its turns alone is longer than half of it; turns
    are never cut. Turns are in order of turn, role and text (null first),
    repeated rows are turns of their own; a null role or text is empty, a null
    conv_id is one conversation. Other columns of the input are not read.
    """
    half = budget // 2
    t = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    t = t.withColumn("tokens", turn_tokens(F.col("text")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("nth", F.row_number().over(order)).withColumn("to", F.sum("tokens").over(so_far)).withColumn("at", F.col("to") - F.col("tokens"))
    t = t.withColumn("span", F.floor(F.col("at") / half))
    t = t.withColumn("span_to", F.max("to").over(Window.partitionBy("conv_id", "span"))).withColumn("all", F.max("to").over(Window.partitionBy("conv_id")))
    own = F.struct(F.col("span").alias("window"), F.lit(False).alias("again"))
    later = F.struct(F.floor(F.col("span_to") / half).alias("window"), F.lit(True).alias("again"))
    system = (F.col("nth") == 1) & (F.col("role") == "system")
    repeats = (F.col("span_to") < F.col("all")) & (F.col("at") >= F.col("span_to") - history) & ~system
    placed = t.select("conv_id", "nth", "role", "text", F.explode(F.when(repeats, F.array(own, later)).otherwise(F.array(own))).alias("p"))
    placed = placed.select("conv_id", "p.window", F.struct((~F.col("p.again")).alias("new"), "nth", "role", "text").alias("item"))
    grouped = placed.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list("item")).alias("items"))
    by_window = Window.partitionBy("conv_id").orderBy("window")
    head = F.first(F.when((F.col("items")[0]["nth"] == 1) & (F.col("items")[0]["role"] == "system"), F.col("items")[0])).over(by_window)
    grouped = grouped.withColumn("head", head).withColumn("nr", F.row_number().over(by_window) - 1)
    kept = F.when(F.col("head").isNotNull() & (F.col("nr") > 0), F.concat(F.array(F.struct(F.lit(False).alias("new"), F.col("head.nth").alias("nth"), F.col("head.role").alias("role"), F.col("head.text").alias("text"))), F.col("items"))).otherwise(F.col("items"))
    parts = F.transform(kept, lambda x: F.struct(x["new"].alias("new"), (x["role"] == "assistant").alias("target"), F.concat(F.lit("<s>[INST] "), escape(x["role"]), F.lit(" [/INST]")).alias("open"), escape(x["text"]).alias("body")))
    done = grouped.select("conv_id", F.col("nr").cast("long").alias("window"), parts.alias("parts"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("loss"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.char_length(x["open"])
        size = F.char_length(x["body"]).cast("long")
        return F.struct((begin + size + 4).alias("at"), F.when(x["new"] & x["target"], F.concat(acc["loss"], F.array(F.struct(begin.alias("start"), size.alias("length"))))).otherwise(acc["loss"]).alias("loss"))

    return done.select(
        "conv_id",
        "window",
        F.size(F.filter("parts", lambda x: ~x["new"])).cast("long").alias("context"),
        F.size(F.filter("parts", lambda x: x["new"])).cast("long").alias("turns"),
        F.concat_ws("", F.transform("parts", lambda x: F.concat(x["open"], x["body"], F.lit("</s>")))).alias("formatted"),
        F.aggregate("parts", start, step, lambda acc: acc["loss"]).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns, loss_text, formatted_chars) from windows(): every turn and target once, in order."""
    every = F.regexp_extract_all("formatted", F.lit(TURN), F.lit(0))
    fresh = F.slice(every, (F.col("context") + 1).cast("int"), F.greatest(F.size(every), F.lit(1)))
    turn_text = F.concat_ws("", F.transform(fresh, lambda x: F.concat(unescape(F.regexp_extract(x, TURN, 1)), F.lit("\n"), unescape(F.regexp_extract(x, TURN, 2)), F.lit("\n"))))
    loss = F.concat_ws("", F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), (x["start"] + 1).cast("int"), x["length"].cast("int")))))
    read = formatted.select("conv_id", "window", F.size(fresh).cast("long").alias("n"), turn_text.alias("turns"), loss.alias("loss_text"), F.char_length("formatted").cast("long").alias("chars"))
    joined = read.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list(F.struct("window", "turns", "loss_text"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    return joined.select("conv_id", "n_turns", F.concat_ws("", F.transform("w", lambda x: x["turns"])).alias("turns"), F.concat_ws("", F.transform("w", lambda x: x["loss_text"])).alias("loss_text"), "formatted_chars")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-1).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(rows.schema["turn"].dataType).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    back = read_back(windows(rows.unionAll(planted)))
    return back.select("conv_id", "n_turns", F.sha2(F.encode("turns", "utf-8"), 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.encode("loss_text", "utf-8"), 256).alias("loss_sha256"), "formatted_chars")


_ESC = rf"regexp_replace(%s, '([<\[])(\\*)({RESTS})', '\1\\\2\3', 'g')"
SQL = f"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) + {OVERHEAD} AS tokens,
         length({_ESC % "text"}) + length({_ESC % "role"}) + {len("<s>[INST]  [/INST]</s>")} AS chars FROM raw
), summed AS (
  SELECT *, row_number() OVER o AS nth, sum(tokens) OVER (o ROWS UNBOUNDED PRECEDING) AS upto FROM sized
  WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), spans AS (
  SELECT *, upto - tokens AS starts, (upto - tokens) // {BUDGET // 2} AS span FROM summed
), ends AS (
  SELECT *, max(upto) OVER (PARTITION BY conv_id, span) AS span_to, max(upto) OVER (PARTITION BY conv_id) AS total FROM spans
), counted AS (
  SELECT conv_id, count(*) AS n_turns, count(DISTINCT span) AS n_windows,
         sum(chars) + sum(CASE WHEN span_to < total AND starts >= span_to - {HISTORY} AND NOT (nth = 1 AND role = 'system') THEN chars ELSE 0 END) AS chars,
         sum(CASE WHEN nth = 1 AND role = 'system' THEN chars ELSE 0 END) AS system_chars,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth) AS turns,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY nth), '') AS loss
  FROM ends GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(chars + (n_windows - 1) * system_chars AS BIGINT) AS formatted_chars
FROM counted
"""
