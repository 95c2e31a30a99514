"""Mixing sources to target weights by cube-method balanced sampling.

Each source gets a target number of words. A document of a source is taken floor(f) times
and once more with probability f - floor(f), where f is target over source size. The cube
method settles these fractions: in a flight, a window of open documents moves along the
null space of two balancing constraints (documents and words) until one is settled, so
both totals stay exact; two small ones per group stay open. Groups are hash buckets of a
source; their open documents are merged level by level, and only the last two of a source
are landed with probabilities kept.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pergament.llm import common

# Fixed value: weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
CAP = 3  # no target above so many times its source's size
BROADCAST_SOURCES = 100_000  # source tables up to so many rows are broadcast, larger ones merged
BUCKET_ROWS = 20_000  # mean rows of a flight group
FANOUT = 64  # groups merged at each further level
WIDTH = 256  # open documents that a move of the flight may change
TRIES = 32
HEAVY = 0.1  # share of the window's spread of sizes from which a document outweighs it


def flight(rows: list[tuple[float, int]], rng: random.Random) -> list[float]:
    """Probabilities after the flight: all 0 or 1 but the last few that no move can settle, two as a rule.

    Open documents enter a window of WIDTH, largest first. Each move goes along the null
    space of the two constraints, in the direction nearest to settling the largest document
    that can move, so its words are made up for by the whole window; what is open at the
    end are small documents.
    """
    p, size = (np.array(c, dtype=np.float64) for c in zip(*rows)) if rows else (np.zeros(0), np.zeros(0))
    queue = np.flatnonzero((p > 0) & (p < 1))
    queue = queue[np.argsort(-size[queue], kind="stable")]
    active, at = queue[:WIDTH], WIDTH
    while len(active) > 1:
        away = size[active] - size[active].mean()
        spread = float(away @ away)
        slope = away / spread if spread > 0 else away
        free = 1 - 1 / len(active) - away * slope  # how far each document alone can move
        k = int((free > 1e-9).argmax())
        if free[k] <= 1e-9:
            break
        # a document that outweighs the window moves with the word total alone kept
        heavy = away[k] * slope[k] > max(HEAVY, 4 / len(active))
        u = -1 / len(active) - away[k] * slope if not heavy else -size[active] * size[active[k]] / float(size[active] @ size[active])
        u[k] += 1
        u[np.abs(u) < 1e-12] = 0
        now, moved = p[active], u != 0
        room = np.where(u > 0, 1 - now, now)[moved] / np.abs(u[moved]), np.where(u > 0, now, 1 - now)[moved] / np.abs(u[moved])
        up, down = float(room[0].min()), float(room[1].min())
        now = now + u * (up if rng.random() * (up + down) < down else -down)
        now[now < 1e-9] = 0.0
        now[now > 1 - 1e-9] = 1.0
        p[active] = now
        active = active[(now > 0) & (now < 1)]
        need = WIDTH - len(active)
        active, at = np.append(active, queue[at : at + need]), at + need
    return p.tolist()


def land(rows: list[tuple[float, int]], rng: random.Random) -> list[float]:
    """Settle what a flight leaves, two by two: probabilities kept, words as near as can be."""
    done = [p for p, _ in rows]
    open_ = sorted((k for k, p in enumerate(done) if 0 < p < 1), key=lambda k: -rows[k][1])
    for k, m in zip(open_[::2], open_[1::2]):
        (p, a), (q, b) = rows[k], rows[m]

        def cost(both: float) -> float:
            cases = ((both, 1, 1), (p - both, 1, 0), (q - both, 0, 1), (1 - p - q + both, 0, 0))
            return sum(w * abs(a * (x - p) + b * (y - q)) for w, x, y in cases)

        both = min(max(0.0, p + q - 1), min(p, q), key=cost)
        draw = rng.random()
        x, y = (1, 1) if draw < both else (1, 0) if draw < p else (0, 1) if draw < p + q - both else (0, 0)
        done[k], done[m] = float(x), float(y)
    if len(open_) % 2:
        done[open_[-1]] = float(rng.random() < done[open_[-1]])
    return done


def settled(rows: list[tuple[float, int]], key: str) -> list[float]:
    """Flight and landing. One that ends farther from the word total than half the median document is
    drawn again, at most TRIES times, and the nearest stays (rejective sampling)."""
    total, sizes = sum(p * s for p, s in rows), sorted(s for p, s in rows if 0 < p < 1)
    best, off = [p for p, _ in rows], float("inf")
    for k in range(TRIES):
        rng = random.Random(zlib.crc32(f"{key}|{k}".encode()))
        done = land([(p, s) for p, (_, s) in zip(flight(rows, rng), rows)], rng)
        now = abs(sum(p * s for p, (_, s) in zip(done, rows)) - total)
        if now < off:
            best, off = done, now
        if off <= (sizes[len(sizes) // 2] if sizes else 0) / 2:
            break
    return best


def sized(docs: DataFrame, row: str | None = None) -> DataFrame:
    """(row, doc_id, source, size, mark): words of each text and a digest of all three, made in the scan."""
    number = docs[row] if row else F.monotonically_increasing_id()
    text, doc_id, source = docs["text"].cast("string"), docs["doc_id"].cast("long"), docs["source"].cast("string")
    words = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    known = [F.coalesce(F.concat(F.lit("="), F.md5(c)), F.lit("none")) for c in (source, text)]
    mark = F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("none")), *known))
    return docs.select(number.alias("row"), doc_id.alias("doc_id"), source.alias("source"), words.alias("size"), mark.alias("mark"))


def told_apart(light: DataFrame) -> DataFrame:
    """Adds nth: 0, 1, ... among rows of one mark. Such rows are alike, so it does not matter which gets which.

    Marks are counted before their shuffle; rows are numbered within their scan partition
    and the partitions' counts summed up, so no mark's rows meet in one task unless one
    partition holds them.
    """
    repeated = common.save(light.groupBy("mark").count().where("count > 1").select("mark"), "repeated")
    if repeated.isEmpty():
        return light.withColumn("nth", F.lit(0).cast("long"))
    part = F.shiftright("row", 33).alias("part")
    rows = common.save(light.select("row", "mark", part).hint("merge").join(repeated.hint("merge"), "mark", "left_semi"), "repeats")
    counts = rows.groupBy("mark", "part").count()
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("mark").orderBy("part")) - F.col("count")).select("mark", "part", "before")
    inner = rows.withColumn("inner", F.row_number().over(Window.partitionBy("mark", "part").orderBy("row")))
    nth = inner.hint("merge").join(before.hint("merge"), ["mark", "part"]).select("row", (F.col("before") + F.col("inner") - 1).alias("nth"))
    return light.hint("merge").join(nth.hint("merge"), "row", "left").withColumn("nth", F.coalesce("nth", F.lit(0).cast("long")))


def ranked(sources: DataFrame) -> DataFrame:
    """Sources (source, ...) with rank: 0, 1, ... by code point, null last.

    They are sorted by ranges and numbered within each; what the driver sums up is one count
    a range.
    """
    spark = sources.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.asc_nulls_last("source")
    at = F.monotonically_increasing_id()  # partition, then place in it
    rows = common.save(sources.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn("at", at), "ranked")
    part = F.shiftright("at", 33)
    before, offsets = 0, []
    for r in rows.groupBy(part.alias("part")).count().orderBy("part").collect():
        offsets += [F.lit(r["part"]), F.lit(before)]
        before += r["count"]
    start = F.create_map(*offsets)[part] if offsets else F.lit(0)
    return rows.withColumn("rank", start + F.col("at") - F.shiftleft(part, 33)).drop("at")


def source_targets(light: DataFrame, weights=WEIGHTS, cap: float = CAP) -> tuple[DataFrame, int]:
    """((source_name, source_size, target), number of documents).

    Weighted shares of the whole, none above cap times its source's size; the excess goes to
    the others by weight. A source is full where its limit by weight lies below the share of
    a unit of weight; each round sums up limits and weights over the table of sources until
    no further one is full, so the driver sees a few sums however many sources there are.
    """
    sources = ranked(light.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    table = common.save(sources.withColumn("weight", weight).withColumn("limit", float(cap) * F.col("size")), "sources")
    total, n_sources, n_rows = table.agg(F.sum("size"), F.count("*"), F.sum("n")).first()
    unit, full = 0.0, F.lit(False)
    while n_sources:
        free, used, n_full = table.agg(F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, F.col("limit"))), F.sum(full.cast("int"))).first()
        if not free:
            break
        unit = (total - (used or 0.0)) / free
        more = full | (F.col("weight") * unit > F.col("limit"))
        if table.agg(F.sum(more.cast("int"))).first()[0] == n_full:
            break
        full = more
    target = F.when(full, F.col("limit")).otherwise(F.col("weight") * F.lit(unit))
    found = table.select(F.col("source").alias("source_name"), F.col("size").alias("source_size"), target.alias("target"))
    return F.broadcast(found) if n_sources <= BROADCAST_SOURCES else common.save(found, "targets").hint("merge"), n_rows or 0


def mix(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, seed: int = 9, row: str | None = None) -> DataFrame:
    """(row, doc_id, size, source_size, target, copies, taken) of every row of ``docs``.

    Null or empty text: size 0, taken 0. A null source is a source of its own, the last.
    Repeated rows are separate documents. Empty table: no rows. Extra columns are ignored.
    Groups depend on doc_id, source, text and seed alone, so reruns agree on any cluster
    (among rows that repeat all three it is open which one is taken). A group of a flight
    holds BUCKET_ROWS rows of a source on average, however large the source is.
    ``row`` names a column of row numbers; without it they are those of this one scan.
    """
    light = common.save(sized(docs, row), "sizes")
    table, n_rows = source_targets(light, weights, cap)
    buckets = max(1, -(-n_rows // BUCKET_ROWS))
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    base = F.floor("ratio")
    rows = (
        told_apart(light).join(table, F.col("source").eqNullSafe(F.col("source_name")))
        .withColumn("ratio", ratio)
        .select("row", "mark", "nth", "doc_id", "source", "size", "source_size", "target", base.alias("base"), (F.col("ratio") - base).alias("p"))
        .withColumn("bucket", F.pmod(F.xxhash64("mark", "nth"), F.lit(buckets)).cast("int"))
    )
    schema = "row long, mark string, nth long, doc_id long, source string, size long, source_size long, target double, base long, p double, bucket int"

    def settle(level: int, last: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["doc_id", "size", "mark", "nth"], na_position="last")
            key = f"{seed}|{level}|{pdf['source'].iloc[0]}|{pdf['bucket'].iloc[0] if not last else 0}"
            units = list(zip(pdf["p"].tolist(), pdf["size"].tolist()))
            return pdf.assign(p=settled(units, key) if last else flight(units, random.Random(zlib.crc32(key.encode()))))

        return run

    finished, level = [], 0
    while True:
        last = buckets == 1
        now = rows.groupBy("source", "bucket").applyInPandas(settle(level, last), schema)
        now = common.save(now, "flight")
        if last:
            finished.append(now)
            break
        finished.append(now.where("p = 0 OR p = 1"))
        buckets, level = -(-buckets // FANOUT), level + 1
        rows = now.where("p > 0 AND p < 1").withColumn("bucket", F.floor(F.col("bucket") / FANOUT).cast("int"))
    whole = finished[0]
    for more in finished[1:]:
        whole = whole.unionByName(more)
    copies = (F.col("base") + F.col("p")).cast("long")
    return whole.select("row", "doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with all columns.

    Null or empty text has no words to take, but may be taken as a document. Null doc_ids and
    sources, repeated rows and very long texts: as for ``mix``. Empty table: no rows. Other
    columns go along, whatever their names.
    """
    rows, name = common.save_numbered(docs)
    chosen = mix(rows, row=name, **how).where("copies > 0").select(F.col("row").alias(name), F.sequence(F.lit(1), "copies").alias("__times"))
    joined = rows.select(name, F.struct(*docs.columns).alias("__doc")).hint("merge").join(chosen.hint("merge"), name)
    return joined.select("__doc", F.explode("__times")).select("__doc.*")
