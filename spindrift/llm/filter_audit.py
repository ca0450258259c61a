"""How a set of filters interact: what each removes, alone, behind others, and as a fair share.

For each intersection of filters (32 for five) the rows that fail all of it are counted, as sums
of products of 0/1 flags. Everything else follows from these joint counts by inclusion-exclusion:
survivors of a set of filters are the alternating sum over its subsets, unique failures the
alternating sum over its supersets. Removal is a coverage game whose Harsanyi dividends are the
joint counts with alternating sign, and a dividend is shared evenly by its members: that is the
Shapley value. Times the number of orders it is a whole number.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import read, settle

MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 50, 65, 5
_WHITE = " \t\n\x0b\x0c\r"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _sum(terms: list[Column]) -> Column:
    return reduce(Column.__add__, terms) if terms else F.lit(0).cast("bigint")


def joint_failures(rows: DataFrame, by: str, flags: list[str], weights: dict[str, Column]) -> DataFrame:
    """One row for each value of ``by``: for each weight an array of joint counts, one for each set of filters.

    ``flags`` name 0/1 columns; place m of an array belongs to the set whose bit i says that
    ``flags[i]`` is in it, place 0 to all rows. Sums merge before the shuffle, so a value that
    holds most rows costs no more than others.
    """
    products = [F.lit(1)] + [reduce(Column.__mul__, [F.col(f) for i, f in enumerate(flags) if m >> i & 1]) for m in range(1, 1 << len(flags))]
    sums = [F.coalesce(F.sum((p * w).cast("bigint")), F.lit(0).cast("bigint")).alias(f"{name}_{m}") for name, w in weights.items() for m, p in enumerate(products)]
    wide = rows.groupBy(by).agg(*sums)
    return wide.select(by, *(F.array(*(F.col(f"{name}_{m}") for m in range(len(products)))).alias(name) for name in weights))


def survivors(joint: Column, n: int) -> Column:
    """Rows that pass all filters of a set, for each set: the alternating sum of joint counts over its subsets."""
    return F.array(*(_sum([joint[t] * (-1) ** t.bit_count() for t in range(1 << n) if t & m == t]) for m in range(1 << n)))


def unique_failures(joint: Column, n: int) -> Column:
    """Rows that fail one filter alone, for each: the alternating sum over all sets that hold it."""
    return F.array(*(_sum([joint[t] * (-1) ** (t.bit_count() - 1) for t in range(1 << n) if t >> i & 1]) for i in range(n)))


def shapley_sums(joint: Column, n: int) -> Column:
    """What each filter removes, summed over all n! orders: its even share of the dividends of all sets that hold it."""
    return F.array(*(_sum([joint[t] * ((-1) ** (t.bit_count() - 1) * (factorial(n) // t.bit_count())) for t in range(1 << n) if t >> i & 1]) for i in range(n)))


def audit(joint: DataFrame, by: str, letters: str, total: str, lost: dict[str, str]) -> DataFrame:
    """One row for each value of ``by``, order of the filters and step in it, from ``joint_failures``.

    ``total`` is the array of all rows' counts; ``lost`` maps further arrays to the names of their
    columns. by, filter_order, step, kept, removed, redundant, unique_fails, ``lost``, shapley.
    """
    n = len(letters)
    steps = []
    for order in permutations(range(n)):
        before = 0
        for step, i in enumerate(order, 1):
            steps.append(("".join(letters[j] for j in order), step, before, i))
            before |= 1 << i
    left = {name: survivors(F.col(name), n) for name in [total, *lost]}
    tables = joint.select(by, F.col(total).alias("joint"), *(c.alias(f"left_{name}") for name, c in left.items()), unique_failures(F.col(total), n).alias("unique"), shapley_sums(F.col(total), n).alias("shares"))
    at = tables.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))))
    listed = [F.array(*map(F.lit, column))[F.col("at")] for column in zip(*steps, strict=True)]
    at = at.select("*", *(c.alias(name) for c, name in zip(listed, ["filter_order", "step", "before", "i"], strict=True)))
    at = at.withColumn("bit", F.array(*(F.lit(1 << i) for i in range(n)))[F.col("i")])
    after = F.col("before") + F.col("bit")
    gone = {name: F.col(f"left_{name}")[F.col("before")] - F.col(f"left_{name}")[after] for name in left}
    return at.select(
        by, "filter_order", "step", F.col(f"left_{total}")[after].alias("kept"), gone[total].alias("removed"), (F.col("joint")[F.col("bit")] - gone[total]).alias("redundant"),
        F.col("unique")[F.col("i")].alias("unique_fails"), *(gone[name].alias(column) for name, column in lost.items()), F.col("shares")[F.col("i")].alias("shapley"),
    )


def text_flags(text: Column) -> dict[str, Column]:
    """0/1 flags of the filters that look at a text alone: few words, repetitive, capitals, symbols."""
    spaced = F.trim(F.translate(text, _WHITE, " " * len(_WHITE)))
    words = F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " +"))
    capitals = F.char_length(text) - F.char_length(F.translate(text, _CAPITALS, ""))
    return {
        "a": (F.size(words) < MIN_WORDS).cast("int"), "b": (100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * F.size(words)).cast("int"),
        "c": (100 * capitals > MAX_CAPITAL_PERCENT * F.char_length(text)).cast("int"), "d": text.rlike("[#$%&*|]").cast("int"),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Failures of the five filters by part, for runs of equal rows: part, a, b, c, d, e (0/1), n, good, toxic.

    Null texts count as empty and a null source as the empty string. ``e`` is an identical text
    at a smaller doc_id anywhere in the table; a null doc_id is smaller than none and has no
    smaller one. Rows of equal doc_id and text aren't smaller than each other. Labels: a document
    is good or toxic if any label row of its doc_id says so. Other columns are left out; an empty
    table gives an empty one.

    Texts are read once and become digests; equal rows merge before every shuffle, so neither a
    text nor a doc_id that fills a third of the table makes a hot key.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint"), text.alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    # the flags follow from the text, so that rows of a digest share them
    rows = rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text"), 256)).alias("digest"), *(c.alias(k) for k, c in text_flags(F.col("text")).items()))
    runs = settle(rows.groupBy("doc_id", "part", "digest", *"abcd").agg(F.count("*").alias("n")), "filter-flags")
    first = runs.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(1))
    kinds = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    runs = runs.join(first, ["digest", "doc_id"], "left").join(kinds, "doc_id", "left")
    e = (F.col("doc_id").isNotNull() & F.col("first").isNull()).cast("int")
    return runs.select("part", *"abcd", e.alias("e"), "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flagged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    joint = joint_failures(rows, "part", list("abcde"), {"rows": F.col("n"), "good": F.col("n") * F.col("good"), "toxic": F.col("n") * F.col("toxic")})
    return audit(joint, "part", "ABCDE", "rows", {"good": "good_lost", "toxic": "toxic_lost"})


#: Replays every order on the failure patterns, without inclusion-exclusion.
ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
listed AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM docs),
kinds AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
fails AS (
    SELECT part, (CASE WHEN len(words) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END)
        || (CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) THEN 'C' ELSE '' END)
        || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > least THEN 'E' ELSE '' END) AS failed,
        coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
    FROM listed LEFT JOIN kinds USING (doc_id)),
patterns AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, failed),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, s::INT AS step, filter_order[s] AS f, filter_order[1:s - 1] AS earlier, filter_order[1:s] AS upto FROM orders, range(1, 6) r(s)),
seen AS (
    SELECT part, filter_order, step, f, n, good, toxic, contains(failed, f) AS fails, failed = f AS alone,
        length(translate(earlier, failed, '')) < length(earlier) AS gone FROM patterns, steps),
counted AS (
    SELECT part, filter_order, step, f, sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM seen GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM counted
"""
