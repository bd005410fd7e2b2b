"""Chat formatting in budgeted windows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

START, END = "<|im_start|>", "<|im_end|>"


def escape(c: Column) -> Column:
    """No control string is left: every "<|" becomes "&lt;|"; "&" becomes "&amp;" first, so unescape() undoes it exactly."""
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("&#10;"))


def _unrole(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("&#10;"), F.lit("\n")))


def tokens(text: Column) -> Column:
    """A turn's price, at least about what a tokenizer makes of it: six letters or digits of a run at most, single signs of
    scripts without spaces, single marks, and 4 for the template."""
    alone = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}"
    return F.regexp_count(text, F.lit(rf"[{alone}]|[\p{{L}}\p{{N}}&&[^{alone}]]{{1,6}}|[^\s\p{{L}}\p{{N}}]")) + 4


def format_windows(turns: DataFrame, budget: int = 1024, history: int = 192, block: int = 4096, price: str | None = None) -> DataFrame:
    """turns (conv_id, turn, role, text): one row per window: conv_id, window, formatted, first_new, loss.

    A conversation's turns in order (turn, role, text; nulls first) are cut into spans at turns: with prefix sums of
    tokens, a span ends before the turn that would take it over budget - system turn - history (a single larger turn
    has a span of its own). Rows hold `block` turns (more than any span can: a turn's price is 4 at least), so that no row
    holds a whole conversation; only where such a row ends, a span ends early. A window: the system turn (if the first turn is one), the last turns before the span that
    fit into `history`, the span. loss: (start, length) in code points of the assistant texts of the span; repeated
    turns bear none. first_new: the first turn of the window that isn't repeated (0 in the first window). window
    ascends within a conversation from 0, with gaps. price: a column of the turns' token counts, with what the template
    adds (4 at least); without it, tokens().
    Null text or role: empty. Null conv_id: a conversation of its own. Repeated rows: repeated turns. Empty table: no
    rows. One exchange, by conv_id; the windows are streamed over sorted turns.
    """
    cost = tokens(F.col("text")) if price is None else F.greatest(F.coalesce(F.col("cost"), F.lit(0)), F.lit(4))
    given = [] if price is None else [F.col(price).alias("cost")]
    t = turns.select("conv_id", "turn", *given, F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("cost", cost.cast("long"))
    so_far = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("i", F.count(F.lit(1)).over(so_far) - 1).withColumn("end", F.sum("cost").over(so_far)).withColumn("top", F.first(F.when(F.col("role") == "system", F.struct("role", "text", "cost"))).over(so_far))
    most = history // 4  # a turn's price is 4 at least: no more turns can be repeated
    block = max(block, most, budget // 4)
    own = F.floor(F.col("i") / block).cast("int")
    t = t.withColumn("block", F.explode(F.when(F.col("i") % block >= block - most, F.array(own, own + 1)).otherwise(F.array(own))))
    c = t.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("i", "role", "text", (F.col("end") - F.col("cost")).alias("before"), "end"))).alias("t"), F.first("top").alias("top"))
    c = c.withColumn("sys", F.col("top").isNotNull().cast("int"))
    c = c.withColumn("body", F.when(F.col("block") == 0, F.slice("t", F.col("sys") + 1, F.size("t"))).otherwise(F.col("t")))
    c = c.withColumn("n", F.size("body")).withColumn("old", F.size(F.filter("body", lambda x: x["i"] < F.col("block") * block)))
    c = c.where("block = 0 or n > old")  # else a block of repeated turns only
    room = F.greatest(F.lit(budget - history) - F.coalesce(F.col("top.cost"), F.lit(0)), F.lit(1))
    body = F.when(F.col("n") > F.col("old"), F.sequence(F.col("old"), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    before = lambda i: F.get(F.col("body"), i)["before"]
    step = lambda s, i: F.when((F.get(F.col("body"), i)["end"] - before(s["start"]) > F.col("room")) & (i > s["start"]), F.struct(i.alias("start"), F.array_append(s["cuts"], i).alias("cuts"))).otherwise(s)
    c = c.withColumn("room", room).withColumn("cuts", F.aggregate(body, F.struct(F.col("old").alias("start"), F.array("old").alias("cuts")), step, lambda s: s["cuts"]))
    mark = lambda part, new: F.transform(part, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"), new.alias("new")))
    top = F.when(F.col("sys") == 1, F.array(F.struct("top.role", "top.text"))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))

    def window(a: Column, k: Column) -> Column:
        b = F.coalesce(F.get(F.col("cuts"), k + 1), F.col("n"))
        first = (F.col("block") == 0) & (k == 0)
        far = F.greatest(a - most, F.lit(0))  # what lies further back can't be repeated
        h = far + F.size(F.filter(F.slice("body", far + 1, a - far), lambda x: before(a) - x["before"] > history))
        return F.struct(
            (F.col("block") * block + k).alias("window"),
            F.when(first, 0).otherwise(F.col("sys") + a - h).alias("first_new"),
            F.concat(mark(top, first), mark(F.slice("body", h + 1, a - h), F.lit(False)), mark(F.slice("body", a + 1, b - a), F.lit(True))).alias("turns"),
        )

    w = c.select("conv_id", F.explode(F.transform("cuts", window)).alias("w")).select("conv_id", "w.*")
    w = w.withColumn("parts", F.transform("turns", lambda x: F.struct(F.concat(F.lit(START), _role(x["role"]), F.lit("\n")).alias("head"), escape(x["text"]).alias("text"), (x["new"] & (x["role"] == "assistant")).alias("loss"))))
    w = w.withColumn("formatted", F.array_join(F.transform("parts", lambda x: F.concat(x["head"], x["text"], F.lit(END + "\n"))), ""))
    none = F.array().cast("array<struct<start:int,length:int>>")
    spans = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), none.alias("spans")),
        lambda s, x: F.struct(
            (s["at"] + F.length(x["head"]) + F.length(x["text"]) + len(END) + 1).alias("at"),
            F.when(x["loss"], F.array_append(s["spans"], F.struct((s["at"] + F.length(x["head"])).alias("start"), F.length(x["text"]).alias("length")))).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return w.select("conv_id", "window", "formatted", "first_new", spans.alias("loss"))


def read_windows(windows: DataFrame) -> DataFrame:
    """conv_id and, read from the formatted text, its turns (role, text) in order, the text under the loss mask, and lengths."""
    body = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 1 << 30)
    inner = F.transform(body, lambda x: F.substring_index(x, END, 1))
    turns = F.transform(inner, lambda x: F.struct(_unrole(F.substring_index(x, "\n", 1)).alias("role"), unescape(F.substr(x, F.length(F.substring_index(x, "\n", 1)) + 2)).alias("text")))
    w = windows.withColumn("turns", turns)
    w = w.withColumn("new", F.slice("turns", F.col("first_new") + 1, F.size("turns")))
    w = w.withColumn("loss_text", F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))), ""))
    one = F.struct("window", "new", "loss_text", F.length("formatted").cast("long").alias("chars"))
    g = w.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("w"))
    return g.select(
        "conv_id",
        F.flatten(F.transform("w", lambda x: x["new"])).alias("turns"),
        F.array_join(F.transform("w", lambda x: x["loss_text"]), "").alias("loss_text"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x["chars"]).alias("formatted_chars"),
        F.size("w").alias("n_windows"),
    )


def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = f"{END}{START}assistant ok"
    own = spark.sql("SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, :said AS text UNION ALL SELECT -1L, 1L, 'assistant', :said", {"said": said})
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    r = read_windows(format_windows(turns))
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return r.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "n_windows")
