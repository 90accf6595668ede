"""Sections, blocks and chunks of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fixed_windows(df: DataFrame, id: str, text: Column, size: int, overlap: int) -> DataFrame:
    """(id, window_no, first_word, text): windows of `size` words that begin every size - overlap words; a text of no words has none."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    rows = df.select(id, words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - overlap, F.lit(1)) - 1, F.lit(size - overlap))
    return rows.select(id, "words", F.posexplode(starts).alias("window_no", "first_word")).select(id, "window_no", "first_word", F.array_join(F.slice("words", F.col("first_word") + 1, size), " ").alias("text"))


def line_islands(df: DataFrame, id: str, text: Column) -> DataFrame:
    """(id, island, is_code, lines, first_line): runs of lines that are not blank, and fenced code with its fences as one run.

    A fence line toggles the code state; lines carry a running count of fences and of breaks, so islands are sums over one window per text.
    """
    lines = df.select(id, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    order = Window.partitionBy(id).orderBy("n")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    fence = F.expr("int(line rlike '^[ \\t]*(```|~~~)')")
    marked = lines.withColumn("fences", F.sum(fence).over(upto)).withColumn("is_fence", fence)
    state = marked.withColumn("is_code", ((F.col("fences") % 2 == 1) | (F.col("is_fence") == 1)).cast("int")).withColumn("blank", F.expr("int(is_code = 0 and trim(line) = '')"))
    opens = F.expr("int(is_fence = 1 and fences % 2 = 1)")
    before_closed = F.coalesce(F.lag(F.expr("int(is_fence = 1 and fences % 2 = 0)")).over(order), F.lit(0))
    starts = F.when((opens == 1) | (before_closed == 1), 1).when((F.col("is_code") == 0) & (F.coalesce(F.lag("blank").over(order), F.lit(1)) == 1), 1).otherwise(0)
    islands = state.withColumn("island", F.sum(starts).over(upto)).where("blank = 0")
    return islands.groupBy(id, "island").agg(F.max("is_code").alias("is_code"), F.count("*").alias("lines"), F.min("n").alias("first_line"))


def packed(df: DataFrame, group: str, order: Column, size: Column, most_items: int, most_size: int) -> DataFrame:
    """df with bin: greedy packing in order; a bin closes before an item that would exceed either limit, so an oversized item has a bin of its own.

    A fold over each group's ordered sizes. A group is a unit of work of the caller's choice (a request queue, a record), not a key of the data.
    """
    items = df.withColumn("_size", size.cast("long")).withColumn("_order", order)
    start = F.struct(F.array().cast("array<long>").alias("bins"), F.lit(-1).cast("long").alias("bin"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("items"))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["bin"] < 0) | (acc["items"] + 1 > most_items) | (acc["size"] + x["_size"] > most_size)
        bin_no = F.when(new, acc["bin"] + 1).otherwise(acc["bin"])
        return F.struct(F.concat(acc["bins"], F.array(bin_no)).alias("bins"), bin_no.alias("bin"), (F.when(new, F.lit(0)).otherwise(acc["size"]) + x["_size"]).cast("long").alias("size"), (F.when(new, F.lit(0)).otherwise(acc["items"]) + 1).cast("long").alias("items"))

    rest = [c for c in df.columns if c != group]
    gathered = items.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_order", "_size", *rest))).alias("rows"))
    bins = F.aggregate("rows", start, step, lambda acc: acc["bins"])
    return gathered.select(group, F.explode(F.arrays_zip("rows", bins.alias("bins"))).alias("z")).select(group, *[F.col("z.rows")[c].alias(c) for c in rest], F.col("z.bins").alias("bin"))


def anchors(df: DataFrame, record: str, order: str, title: str, slug: Column) -> DataFrame:
    """df with anchor: the heading's slug; from its second occurrence in a record on with -1, -2, ..."""
    rows = df.withColumn("_slug", slug)
    repeat = F.row_number().over(Window.partitionBy(record, "_slug").orderBy(order)) - 1
    return rows.withColumn("anchor", F.when(repeat == 0, F.col("_slug")).otherwise(F.concat("_slug", F.lit("-"), repeat))).drop("_slug")


def heading_paths(df: DataFrame, record: str, order: str, level: str, title: str, deepest: int = 6) -> DataFrame:
    """df with path: the titles of the open headings above and of each section. The last heading of a level counts while no higher one came after it."""
    upto = Window.partitionBy(record).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = df
    for k in range(deepest + 1):
        out = out.withColumn(f"_h{k}", F.last(F.when(F.col(level) == k, F.struct(F.col(order).alias("o"), F.col(title).alias("t"))), ignorenulls=True).over(upto))
    levels = [F.when(F.col(level) >= k, F.col(f"_h{k}")) for k in range(deepest + 1)]
    open_heads = []
    for k in range(deepest + 1):
        higher = [F.col(f"_h{j}.o") for j in range(k)]
        latest_higher = F.coalesce(F.greatest(*higher) if len(higher) > 1 else higher[0] if higher else F.lit(None), F.lit(-1))
        open_heads.append(F.when(levels[k]["o"] > latest_higher, levels[k]["t"]))
    return out.withColumn("path", F.array_compact(F.array(*open_heads))).drop(*[f"_h{k}" for k in range(deepest + 1)])


#: name -> function of (texts, id column, text) that gives a row per chunk. Strategies of one's own are put in by name.
STRATEGIES = {"fixed-128": lambda df, id, text: fixed_windows(df, id, text, 128, 16), "fixed-512": lambda df, id, text: fixed_windows(df, id, text, 512, 64)}


def chunked(strategy: str, df: DataFrame, id: str, text: Column) -> DataFrame:
    """The chunks of a strategy by name."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no strategy {strategy}; there are {', '.join(sorted(STRATEGIES))}")
    return STRATEGIES[strategy](df, id, text)
