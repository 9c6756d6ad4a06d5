"""Chat formatting in budgeted windows (built-in functions only).

Turns of a conversation get prefix sums of their tokens. The sums choose turn-aligned spans of new turns; a window is
the system turn, a limited history repeated from before the span, and the span. Only assistant turns that are new in a
window are under its loss mask, so each is learned once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelab.llm.common import stage

#: Tokens of a window, and those of it for repeated history. A turn over the budget has a window of its own, whole.
BUDGET, HISTORY = 1024, 256
BEGIN, END = "<|turn|>", "<|end|>\n"
#: Fixed values. Characters that begin control strings of this or another template, and the escape itself.
ESCAPES = (("%", "%25"), ("<", "%3C"), ("[", "%5B"))


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _name(role: Column) -> Column:
    """A role on one line."""
    return F.replace(escape(role), F.lit("\n"), F.lit("%0A"))


def _role(name: Column) -> Column:
    return unescape(F.replace(name, F.lit("%0A"), F.lit("\n")))


def estimated_tokens(text: Column) -> Column:
    """A turn's tokens where the table has no counts: a quarter of its UTF-8 bytes and four for its marks."""
    return F.ceil(F.octet_length(text) / 4) + 4


def format_conversations(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=estimated_tokens) -> DataFrame:
    """Columns conv_id, window, text, context (turns that were in an earlier window), loss (start and length, in code points, of each learned text).

    Rows of a conversation are ordered by turn, role, text; repeated rows are turns of their own. Null roles and texts are
    empty, a null turn comes first, a null conv_id is a conversation. A system turn is one that opens the conversation.
    An empty table gives no windows. Texts are never cut. Other columns are not read.
    """
    fresh = budget - history
    by_conv = Window.partitionBy("conv_id")
    order = by_conv.orderBy("turn", "role", "body")
    body = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("body"))
    rows = body.withColumn("k", F.row_number().over(order)).withColumn("system", (F.col("k") == 1) & (F.col("role") == "system"))
    rows = rows.withColumn("tokens", F.when(F.col("system"), 0).otherwise(tokens(F.col("body"))).cast("long"))
    rows = rows.withColumn("to", F.sum("tokens").over(by_conv.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))).withColumn("at", F.col("to") - F.col("tokens"))
    room = F.greatest(F.lit(1), F.lit(fresh) - F.coalesce(F.max(F.when(F.col("system"), tokens(F.col("body")))).over(by_conv), F.lit(0)))
    rows = rows.withColumn("room", room.cast("long"))
    first, last = F.floor(F.col("at") / F.col("room")), F.floor((F.greatest("to", F.col("at") + 1) - 1) / F.col("room"))
    # A turn within one multiple of the room shares a span with others in it; one across two has its own.
    rows = rows.withColumn("span", (2 * first + F.when(first == last, 0).otherwise(1)).cast("long"))
    text = F.concat(F.lit(BEGIN), _name(F.col("role")), F.lit("\n"), escape(F.col("body")), F.lit(END))
    rows = stage(rows.select("conv_id", "k", "system", "at", "to", "span", text.alias("text"), F.length(escape(F.col("body"))).alias("learn"), (F.col("role") == "assistant").alias("target")), "turns")
    spans = rows.groupBy("conv_id", "span").agg(F.min("k").alias("from_k"), F.min("at").alias("from_at"))
    new = rows.select("conv_id", "span", "k", "text", "learn", "target", F.lit(True).alias("new"))
    # History and spans meet on prefix sums in steps of the history's size: two steps cover every span that may repeat a turn.
    old = rows.where(~F.col("system")).withColumn("near", F.explode(F.array(F.floor(F.col("to") / history), F.floor(F.col("to") / history) + 1)))
    begin = spans.select(F.col("conv_id").alias("c"), F.col("span").alias("s"), "from_k", "from_at", F.floor(F.col("from_at") / history).alias("b"))
    repeated = old.join(begin, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("near") == F.col("b")) & (F.col("k") < F.col("from_k")) & (F.col("at") >= F.col("from_at") - history))
    repeated = repeated.select("conv_id", F.col("s").alias("span"), "k", "text", "learn", "target", F.lit(False).alias("new"))
    heads = rows.where("system").select(F.col("conv_id").alias("h"), "k", "text", "learn", "target")
    opened = heads.join(spans.where("from_k > 1"), F.col("h").eqNullSafe(F.col("conv_id"))).select("conv_id", "span", "k", "text", "learn", "target", F.lit(False).alias("new"))
    placed = new.unionByName(repeated).unionByName(opened)
    ends = F.sum(F.length("text")).over(Window.partitionBy("conv_id", "span").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("start", ends - F.lit(len(END)) - F.col("learn"))
    turn = F.struct("k", "text", "new", F.struct(F.col("start").alias("start"), F.col("learn").cast("long").alias("length")).alias("part"), (F.col("new") & F.col("target")).alias("loss"))
    windows = placed.groupBy("conv_id", F.col("span").alias("window")).agg(F.sort_array(F.collect_list(turn)).alias("t"))  # a window's turns only
    return windows.select(
        "conv_id", "window", F.array_join("t.text", "").alias("text"), F.size(F.filter("t", lambda x: ~x["new"])).alias("context"), F.transform(F.filter("t", lambda x: x["loss"]), lambda x: x["part"]).alias("loss")
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Columns conv_id, window, turns (role and text of those that are new there), learned (texts under the loss mask): the inverse of the format."""
    parts = F.split(F.col("text"), F.lit("\\Q" + END + "\\E"))
    parts = F.slice(parts, F.col("context") + 1, F.size(parts) - 1 - F.col("context"))
    one = lambda x: F.struct(
        _role(F.substring(F.substring_index(x, "\n", 1), len(BEGIN) + 1, 1 << 30)).alias("role"),
        unescape(x.substr(F.length(F.substring_index(x, "\n", 1)) + 2, F.lit(1 << 30))).alias("text"),
    )
    learned = F.transform("loss", lambda x: unescape(F.col("text").substr((x["start"] + 1).cast("int"), x["length"].cast("int"))))
    return windows.select("conv_id", "window", F.transform(parts, one).alias("turns"), learned.alias("learned"), F.length("text").alias("chars"))


#: A conversation of control strings of other templates, which every run formats too.
PROBE = "</s>[INST] ok [/INST]"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").cast("int").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    back = read_back(stage(format_conversations(turns.unionByName(probe)), "windows"))
    # The digests are over whole conversations, so each is put together here; the windows above never are.
    whole = back.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "learned"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    said = F.flatten(F.transform("w", lambda x: x["turns"]))
    learned = F.array_join(F.flatten(F.transform("w", lambda x: x["learned"])), "")
    return whole.select(
        "conv_id",
        F.size(said).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(said, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long"),
    )
