"""Work done once for each distinct value: a written dictionary, joined back to the rows.

Text rules are long chains of patterns, and the values of record tables (labels, names,
places, dates) repeat. The distinct values are combined before their shuffle, the rules run
on them alone, and the dictionary is a table, so its size is known when the rows come back
to it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pergament.functions.text import kept
from pergament.sources.scratch import stored

#: Distinct values up to which a dictionary is broadcast, and their bytes.
FEW_VALUES, FEW_BYTES = 100_000, 32 << 20


def dealt(values: DataFrame, *keys: str) -> DataFrame:
    """Distinct values in spark.sql.shuffle.partitions even parts, for work that costs far more than their bytes tell.

    Adaptive execution joins the partitions of a shuffle by bytes; a few megabytes of short
    values would end in one or two tasks. Partitions of a stated number stay as they are;
    they go by a hash of their own, since a second shuffle by the same keys would be dropped.
    """
    return values.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*keys))


def dictionary(rows: DataFrame, keys: list[str], work: Callable[[DataFrame], DataFrame], name: str = "dictionary") -> DataFrame:
    """The written table of ``work`` over the distinct combinations of ``keys``; nulls take no part."""
    there = rows.select(*keys).where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    return stored(work(dealt(there.distinct(), *keys)), name)


def fits(values: DataFrame, keys: list[str]) -> bool:
    """Whether a written table is few values, by their number and the bytes of their keys."""
    text = [F.col(k) if values.schema[k].dataType.typeName() == "string" else F.to_json(k) for k in keys]
    n, size = values.agg(F.count("*"), F.sum(sum(map(F.octet_length, text), F.lit(0)))).first()
    return n <= FEW_VALUES and (size or 0) <= FEW_BYTES


def looked_up(rows: DataFrame, values: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows joined with their entry in a written dictionary; those without one go, or stay with ``how`` left.

    Few values, by their number and the bytes of their keys, are broadcast. Beyond that both
    sides are sorted and merged; the join is a plain one, so Spark splits the large
    partitions that a frequent value makes.
    """
    if fits(values, keys):
        return rows.join(F.broadcast(values), keys, how)
    return rows.hint("merge").join(values.hint("merge"), keys, how)


def by_value(rows: DataFrame, keys: list[str], work: Callable[[DataFrame], DataFrame], name: str = "dictionary") -> DataFrame:
    """Rows with what ``work`` adds to their keys, computed once for each distinct combination."""
    return looked_up(rows, dictionary(rows, keys, work, name), keys)


LONG_VALUE = 256  # bytes of a value that is remembered


def frequent(rows: DataFrame, keys: list[str], work: Callable[[DataFrame], DataFrame], name: str = "frequent") -> DataFrame:
    """The written table (keys, __known) of what ``work`` adds to values that repeat, as a struct.

    All values are counted. Of those that repeat the most frequent, FEW_VALUES at most, none
    longer than LONG_VALUE, go through ``work`` once.
    """
    size = reduce(lambda a, b: a + b, (F.octet_length(k) for k in keys))
    often = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where((F.col("__n") > 1) & (size <= LONG_VALUE))
    values = stored(often.orderBy(F.desc("__n"), *keys).limit(FEW_VALUES).select(*keys), name)
    made = work(dealt(values, *keys))
    return stored(made.select(*keys, F.struct(*(c for c in made.columns if c not in keys)).alias("__known")), name)


def recalled(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the column __known of a table of ``frequent`` values, null for all others."""
    return rows.join(F.broadcast(known), keys, "left")


def told(name: str, otherwise: Column) -> Column:
    """What is known of a recalled value, worked out in place for one that is not frequent."""
    return F.when(F.col("__known").isNotNull(), F.col(f"__known.{name}")).otherwise(otherwise)


def remembered(rows: DataFrame, keys: list[str], work: Callable[[DataFrame], DataFrame], name: str = "frequent") -> DataFrame:
    """Rows with the column __known: what ``work`` adds to ``frequent`` values, as a struct, else null.

    The frequent values are broadcast; a row with any other value is worked out where it
    stands. So no row is moved, and values without repeats, such as numbers of cards, need
    neither shuffle nor dictionary.
    """
    return recalled(rows, frequent(rows, keys, work, name), keys)


def under_rules(values: DataFrame, kind: str, read: str, rules: dict[str, Callable[[Column], Column]], test: Callable[[Column], Column] | None = None) -> DataFrame:
    """Values with the column value that the rule of their kind makes of ``read``; other kinds go.

    Each kind is a branch over the written values, so no row carries the code of other kinds.
    With a test only the values that pass it stay.
    """
    values = stored(values, "readings")
    one = lambda k: values.where(F.col(kind) == k)
    made = [kept(one(k), "value", rule(F.col(read)), test) if test else one(k).withColumn("value", rule(F.col(read))) for k, rule in rules.items()]
    return reduce(DataFrame.unionByName, made)
