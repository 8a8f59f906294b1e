"""Interaction of document filters: what each removes after any others, and its share over all orders.

A row's failures are one bit a filter. Rows are counted by part, failures and labels first (sums on the map side), so what follows has at most
32 x 4 rows a part. Each of these contributes to the 80 edges (already-applied subset, next filter) of the
lattice of subsets; an order of the five filters is a path of five edges, so the 600 steps of the 120 orders are a join of the
summed edges with the table of steps.

Filters (a row fails; words are runs of anything but white space \\x20, \\x09-\\x0D, case-sensitive):
A under 200 words; B 100 * distinct words < 50 * words; C 100 * [A-Z] characters > 3 * code points;
D holds any of #$%&*|; E its text is that of a row with a smaller doc_id, whether that one is removed or not.

E needs no group of copies in one task: the least doc_id of each text is an aggregate, and a row passes where
(text, doc_id) is one of these, a join on both.

Cases: a null text is empty, and equal to an empty one; a null part is the part ''; a row with a null doc_id has no labels, passes E and
makes no other row fail it; rows with equal doc_id and text both pass E where no smaller doc_id has the text;
of repeated labels any that is 1 counts; an empty table gives no parts, so no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table, text_of

#: Fixed values of the filters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
#: Most filters: their orders are a table of n! * n rows made on the driver.
MOST_FILTERS = 7
FIRST = "E"


def text_filters(text: Column) -> dict[str, Column]:
    """What rows fail by their text alone: a condition by filter."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > MOST_CAPITALS * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame, filters: Mapping[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, fails): bits in the order of the filters, that of repeated texts last. A table: texts are read once."""
    filters = text_filters(F.col("text")) if filters is None else filters
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_of(text_col).alias("text"))
    bits = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(filters.values())), F.lit(0))
    keys = materialize(plain.select("doc_id", "part", bits.alias("fails"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")), "failures")
    firsts = keys.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return keys.join(firsts, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("fails") + F.when(copy, 1 << len(filters)).otherwise(0)).alias("fails"))


def labelled(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """rows with good and toxic, by doc_id."""
    known = labels.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    return rows.join(known, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def edges(rows: DataFrame, names: str) -> DataFrame:
    """(part, applied, filter, sums) of each edge: applied is the bits of the filters before. rows: part, fails, good, toxic."""
    groups = rows.groupBy("part", "fails", "good", "toxic").agg(F.count("*").alias("n"))
    every = F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(name).alias("filter"), F.lit(1 << k).alias("bit")) for k, name in enumerate(names) for s in range(1 << len(names)) if not s >> k & 1))
    at = groups.withColumn("e", F.explode(every)).select("*", "e.*")
    fails, before = F.col("fails").bitwiseAND(F.col("bit")) != 0, F.col("fails").bitwiseAND(F.col("applied")) != 0
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return at.groupBy("part", "applied", "filter").agg(
        total(~fails & ~before).alias("kept"), total(fails & ~before).alias("removed"), total(fails & before).alias("redundant"), total(F.col("fails") == F.col("bit")).alias("unique_fails"),
        total(fails & ~before & F.col("good")).alias("good_lost"), total(fails & ~before & F.col("toxic")).alias("toxic_lost"))


def orders(names: str) -> list[tuple[str, int, int, str]]:
    """(order, step, applied, filter) of all steps of all orders."""
    if len(names) > MOST_FILTERS or len(set(names)) < len(names):
        raise ValueError(f"up to {MOST_FILTERS} filters of different names")
    out = []
    for order in permutations(names):
        applied = 0
        for step, name in enumerate(order, 1):
            out.append(("".join(order), step, applied, name))
            applied |= 1 << names.index(name)
    return out


def audit(rows: DataFrame, names: str) -> DataFrame:
    """Per part, order and step: the sums of its edge, and the filter's removals over all orders. rows: part, fails, good, toxic."""
    steps = rows.sparkSession.createDataFrame(orders(names), "filter_order string, step int, applied int, filter string")
    paths = edges(rows, names).join(F.broadcast(steps), ["applied", "filter"])
    share = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return paths.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", share.alias("shapley"))


def op12(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return audit(labelled(failures(docs), table(spark, sf_dir, "labels")), "ABCD" + FIRST)


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, [w FOR w IN regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF w <> ''] AS w FROM documents),
f AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS fails FROM d),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM x a, x b, x c, x d, x e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1 : step - 1]), 0)::INT AS applied FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
p AS (SELECT part, filter_order, step, bit, sum(CASE WHEN fails & bit = 0 AND fails & applied = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails & bit <> 0 AND fails & applied = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN fails & bit <> 0 AND fails & applied <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN fails & bit <> 0 AND fails & applied = 0 AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN fails & bit <> 0 AND fails & applied = 0 AND toxic THEN n ELSE 0 END) AS toxic_lost FROM g, s GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM p
"""
