"""Problem 4: one ranking from scores on different scales, by robust rank aggregation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.session import written

#: Rows of one question up to which a question's lists are ranked together in one task, after a single shuffle by question.
QUESTION_ROWS = 200_000
#: Lists up to which probabilities are sums of terms with factorials, compiled with the rest of the plan; of more lists they come by a recurrence. Both give the same.
FACTORIALS = 20


def clean_hits(hits: DataFrame, configs: DataFrame) -> DataFrame:
    """(question_id, config_id, content_id, strength): one row per hit, the last loaded; strength is higher for better hits of either kind of score.

    Null and NaN scores count as no hit, as do null keys and configs that the table of configs doesn't have."""
    rows = hits.where("question_id is not null and config_id is not null and content_id is not null").select("question_id", F.col("config_id").cast("int").alias("config_id"), F.col("content_id").cast("long").alias("content_id"), F.col("score").cast("double").alias("score"), F.coalesce(F.col("loaded_at").cast("long"), F.lit(-1)).alias("t"))
    # Null scores join the newest-row choice, so that a withdrawn score isn't replaced by an older one.
    one = rows.groupBy("question_id", "config_id", "content_id").agg(F.max_by("score", F.struct("t", "score")).alias("score")).where("score is not null and not isnan(score)")
    kinds = configs.where("config_id is not null").groupBy(F.col("config_id").cast("int").alias("config_id")).agg(F.max(F.expr("int(score_kind = 'distance')")).alias("down"))
    return one.join(kinds, "config_id").select("question_id", "config_id", "content_id", F.expr("if(down = 1, -score, score)").alias("strength"))


def _ranged(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """rows with part and offset: cut into ranges of the whole order by key and `order`, whose sizes tell how many rows of its key lie before a part. Rows that the order doesn't tell apart
    are in one part. The ranges follow samples of the rows, so that they hold about as many each however the values are spread."""
    count = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = written(rows.repartitionByRange(count, *key, *order).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.groupBy(*key, "part").agg(F.count("*").alias("in_part")).withColumn("offset", F.coalesce(F.sum("in_part").over(before), F.lit(0))).drop("in_part")
    return ranges.join(offsets, [*key, "part"])


def list_ranks(rows: DataFrame) -> DataFrame:
    """rows with position: the mean rank of a hit in its list (ties share their mean), 1 for the strongest. Lists are cut into ranges of their order, so that no task sorts a whole long list."""
    key = ["question_id", "config_id"]
    within = Window.partitionBy(*key, "part").orderBy(F.col("strength").desc())
    ties = Window.partitionBy(*key, "part", "strength")
    ranked = _ranged(rows, key, [F.col("strength").desc()]).withColumn("first", F.rank().over(within)).withColumn("ties", F.count("*").over(ties))
    return ranked.select(*key, "content_id", (F.col("offset") + F.col("first") + (F.col("ties") - 1) / 2).alias("position"))


def _order_statistic(k: Column, n: Column, r: Column, most: int) -> Column:
    """Probability that the k-th smallest of n uniform numbers is at most r: the beta(k, n - k + 1) distribution as a binomial tail."""
    def term(i: int) -> Column:
        choose = F.factorial(n) / (F.factorial(F.lit(i)) * F.factorial(n - i))
        return F.when((k <= i) & (n >= i), choose * F.pow(r, F.lit(float(i))) * F.pow(1 - r, (n - i).cast("double"))).otherwise(0.0)

    total = term(1)
    for i in range(2, most + 1):
        total = total + term(i)
    return F.least(F.lit(1.0), total)


def _binomial_tail(k: Column, n: Column, r: Column) -> Column:
    """The same for any number of lists: terms by a recurrence of their logarithms, added up from k on."""
    start = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        log = acc["log"] + F.log((n - i + 1) / i)  # of n choose i
        return F.struct(log.alias("log"), (acc["sum"] + F.when(i >= k, F.exp(log + i * F.log(r) + F.when(i < n, (n - i) * F.log(1 - r)).otherwise(0.0))).otherwise(0.0)).alias("sum"))

    return F.when(r >= 1, 1.0).otherwise(F.least(F.lit(1.0), F.aggregate(F.sequence(F.lit(1), n.cast("int")), start, step, lambda acc: acc["sum"])))


def _together(hits: DataFrame, configs: DataFrame) -> DataFrame:
    """(question_id, content_id, ranks, n lists, m contents, present): all steps work on the one partitioning by question."""
    rows = clean_hits(hits.repartition("question_id"), configs)
    per_list = Window.partitionBy("question_id", "config_id").orderBy(F.col("strength").desc())
    ranked = rows.select(
        "question_id", "content_id",
        (F.rank().over(per_list) + (F.count("*").over(per_list.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2).alias("position"),
        F.dense_rank().over(Window.partitionBy("question_id").orderBy("config_id")).alias("list_no"),
    )
    per_item = ranked.groupBy("question_id", "content_id").agg(F.sort_array(F.collect_list("position")).alias("ranks"), F.max("list_no").alias("list_no"))  # at most one per config
    question = Window.partitionBy("question_id")
    return per_item.select("question_id", "content_id", "ranks", F.max("list_no").over(question).alias("n"), F.count("*").over(question).alias("m"), F.size("ranks").alias("present"))


def _apart(hits: DataFrame, configs: DataFrame) -> DataFrame:
    """The same where one question holds more rows than a task should: every step is keyed finer than by question."""
    rows = list_ranks(clean_hits(hits, configs))
    per_item = rows.groupBy("question_id", "content_id").agg(F.sort_array(F.collect_list("position")).alias("ranks"))
    totals = rows.groupBy("question_id").agg(F.count_distinct("config_id").alias("n"))
    contents = per_item.groupBy("question_id").agg(F.count("*").alias("m"))
    return per_item.join(totals, "question_id").join(contents, "question_id").select("question_id", "content_id", "ranks", "n", "m", F.size("ranks").alias("present"))


def aggregate_ranks(hits: DataFrame, configs: DataFrame) -> DataFrame:
    """(question_id, content_id, lists, significance, mean_rank): what orders each question's contents so that every config counts alike.

    The position of a hit in its config's list is divided by the number of contents any list of the question has; a content that a list lacks
    has 1 there. Its normalised ranks are sorted, each k-th one gets the probability that the k-th of as many uniform ranks is as small
    (beta order statistics), and the smallest, times the number of lists, is its significance. Places, as `ranking` gives them, follow significance, then more lists, the better mean rank and the smaller id.

    Redelivered hits count once; null and NaN scores are no hit; a question without a hit has no ranking; tied scores share their mean
    rank; configs not in the table and null keys are left out.
    """
    most = max(1, configs.select("config_id").distinct().count())
    largest = hits.groupBy("question_id").count().agg(F.max("count")).first()[0] or 0
    wide = _together(hits, configs) if largest <= QUESTION_ROWS else _apart(hits, configs)
    if most <= FACTORIALS:
        probabilities = [F.when(F.col("present") >= k, _order_statistic(F.lit(k), F.col("n"), F.least(F.lit(1.0), F.element_at("ranks", k) / F.col("m")), most)).otherwise(1.0) for k in range(1, most + 1)]
        least = probabilities[0] if most == 1 else F.least(*probabilities)
    else:
        least = F.array_min(F.transform("ranks", lambda p, k: _binomial_tail(k + 1, F.col("n"), F.least(F.lit(1.0), p / F.col("m")))))
    mean = (F.aggregate("ranks", F.lit(0.0), lambda a, x: a + x) + (F.col("n") - F.col("present")) * F.col("m")) / (F.col("n") * F.col("m"))
    scored = wide.select("question_id", "content_id", F.col("present").alias("lists"), F.round(F.least(F.lit(1.0), least * F.col("n")), 12).alias("significance"), F.round(mean, 12).alias("mean_rank"))
    return scored


def first_places(hits: DataFrame, configs: DataFrame) -> DataFrame:
    """(question_id, content_id): the content in first place; a question's contents are reduced where they lie, not sorted together."""
    best = aggregate_ranks(hits, configs).groupBy("question_id").agg(F.min(F.struct("significance", (-F.col("lists")).alias("l"), "mean_rank", "content_id")).alias("b"))
    return best.select("question_id", F.col("b.content_id").alias("content_id"))


def _places(scored: DataFrame) -> DataFrame:
    """scored with place where one question holds more contents than a task should sort."""
    order = ["significance", F.col("lists").desc(), "mean_rank", "content_id"]
    within = Window.partitionBy("question_id", "part").orderBy(*order)
    return _ranged(scored, ["question_id"], order).withColumn("first", F.row_number().over(within)).withColumn("place", (F.col("offset") + F.col("first")).cast("int"))


def ranking(hits: DataFrame, configs: DataFrame, k: int | None = None) -> DataFrame:
    """(question_id, content_id, place, significance, lists): every place of each question's ranking, or its first k (a top-k report)."""
    scored = aggregate_ranks(hits, configs)
    if k is None and (scored.groupBy("question_id").count().agg(F.max("count")).first()[0] or 0) > QUESTION_ROWS:
        placed = _places(scored)
    else:
        order = Window.partitionBy("question_id").orderBy("significance", F.col("lists").desc(), "mean_rank", "content_id")
        placed = scored.withColumn("place", F.row_number().over(order))
    if k is not None:
        placed = placed.where(F.col("place") <= k)
    return placed.select("question_id", "content_id", "place", "significance", "lists")
