"""Quality rules as a short-circuit cascade.

The cost and the rejection rate of every rule are measured on a sample; the rules then run
in the order of rejection per cost, and a document stops at the first rule that rejects it.
The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pergament.llm import common

SYMBOLS = b"#*$%&|<>"
NOT_SYMBOLS = bytes(set(range(256)) - set(SYMBOLS))
CONTINUATION = bytes(range(0x80, 0xC0))
SPACES = b"\t\n\x0b\x0c\r "
WINDOW = 5
SAMPLE_ROWS = 500
SPARE = 4  # times as many rows are looked at, since texts repeat


class Text:
    """One text's measures, each computed when first asked for and then remembered."""

    def __init__(self, text: str | None):
        self.data = (text or "").encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.data.translate(None, CONTINUATION + SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.data.translate(None, NOT_SYMBOLS))

    @cached_property
    def lines(self) -> tuple[int, int]:
        """Lines with a word, and those of them that equal an earlier one."""
        own = [line for line in self.data.split(b"\n") if line.strip(SPACES)]
        return len(own), len(own) - len(set(own))

    @property
    def n_lines(self) -> int:
        return self.lines[0]

    @property
    def n_dup_lines(self) -> int:
        return self.lines[1]

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)


def repeated_words(words: list[bytes], k: int = WINDOW) -> int:
    """Words that lie in a k-word window that occurs twice or more, its first place included."""
    n = len(words) - k + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    if len(known) ** k < 1 << 63:
        key = ids[:n].copy()
        for j in range(1, k):
            key = key * len(known) + ids[j : j + n]
    else:
        key = ids[:n]
        for j in range(1, k):  # ranks stay below n, so a pair always fits
            key = np.unique(key, return_inverse=True)[1] * len(known) + ids[j : j + n]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(key, twice))
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


#: name -> True where the text is rejected. Integer comparisons, so SQL can restate them.
RULES: dict[str, Callable[[Text], bool]] = {
    "few_words": lambda t: t.n_words < 10,
    "repeated_windows": lambda t: 100 * t.n_repeat_words > 20 * t.n_words,
    "symbols": lambda t: 10 * t.n_symbols > t.n_words and t.n_words > 0,
    "word_length": lambda t: t.n_words > 0 and not 2 * t.n_words <= t.word_chars <= 20 * t.n_words,
    "repeated_lines": lambda t: t.n_dup_lines >= 3 and 10 * t.n_dup_lines > 3 * t.n_lines,
}


def plan(docs: DataFrame, rules=None, rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names in the order to run them, from a sample of at most ``rows`` texts.

    The sample, distinct texts whose hashes are among the smallest, only orders the rules,
    so a text that stands very often counts once. The hash range is chosen by the number of
    rows, so one pass over the texts finds it. A rule that rejects nothing comes last,
    cheapest first.
    """
    rules = rules or RULES
    share = min(1.0, SPARE * rows / max(docs.count(), 1))
    low = F.lit(min(int(share * (1 << 64)), (1 << 64) - 1) - (1 << 63))
    texts = docs.select(F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text")).where(F.col("h") <= low)
    sample = texts.groupBy("h").agg(F.first("text").alias("text")).orderBy("h").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, hit, seen = dict.fromkeys(rules, 0.0), dict.fromkeys(rules, 0), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen += 1
                for name, rule in rules.items():
                    t = Text(text)
                    began = time.perf_counter()
                    hit[name] += bool(rule(t))
                    cost[name] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": list(rules), "cost": list(cost.values()), "hit": list(hit.values()), "seen": [seen] * len(rules)})

    measured = sample.select("text").mapInArrow(run, "rule string, cost double, hit long, seen long")
    sums = {r["rule"]: (r["hit"], r["cost"]) for r in measured.groupBy("rule").agg(F.sum("hit").alias("hit"), F.sum("cost").alias("cost")).collect()}
    found = {name: sums.get(name, (0, 0.0)) for name in rules}
    return sorted(rules, key=lambda name: (-found[name][0] / max(found[name][1], 1e-9), found[name][1], name))


def first_failure(text: Text, order: list[str], rules=None) -> str | None:
    rules = rules or RULES
    return next((name for name in order if rules[name](text)), None)


def cascade(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs`` with its measures, failed_rule and kept.

    The verdict comes from the cascade; the measures are reported for every text, and those
    that a rule has asked for are not made again. Null or
    empty text: no words, rejected. Null doc_ids and repeated rows stay; an empty table
    gives no rows; extra columns are ignored.
    """
    order = order or plan(docs)
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, failed_rule string"
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = Text(text)
                failed = first_failure(t, order)
                n, repeated = t.n_words, t.n_repeat_words
                base = n < 10 or 100 * repeated > 20 * n
                rows.append((doc_id, n, t.word_chars, t.n_symbols, t.n_dup_lines, repeated, base, failed is None, failed))
            types = [*[pa.int64()] * 6, pa.bool_(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return common.need(docs, doc_id="long", text="string").mapInArrow(run, schema)


def keep(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all columns; each text runs until its first failure.

    Null or empty text: rejected. Null doc_ids and repeated rows stay as they are; very long
    texts are judged whole; an empty table gives no rows; other columns go along, whatever
    their names.
    """
    order = order or plan(docs)
    common.bound_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([first_failure(Text(t), order) is None for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def oracle() -> str:
    """DuckDB SQL for ``cascade`` without failed_rule, which depends on measured times."""
    return r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM w),
k AS (SELECT r, i, w[i:i+4] AS k FROM g),
b AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM k),
p AS (SELECT DISTINCT r, i + j AS at FROM b, unnest(range(0, 5)) AS u(j) WHERE c > 1),
n AS (SELECT r, count(*) AS n FROM p GROUP BY r),
m AS (SELECT w.r, doc_id, len(w)::BIGINT AS n_words, length(list_aggregate(w, 'string_agg', ''))::BIGINT AS wc,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines, coalesce(n.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN n ON w.r = n.r)
SELECT doc_id, n_words, coalesce(wc, 0)::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words OR NOT (coalesce(wc, 0) BETWEEN 2 * n_words AND 20 * n_words) OR n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines) AS kept
FROM m"""
