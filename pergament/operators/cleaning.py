"""The text rules as one job over a table, with a report of what they did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pergament.functions import text as X

#: Rule name to a function of a column and further arguments (a profile, a field, a mode).
RULES = {
    "normalize": X.normalize_text, "fold": X.fold, "key": X.key, "phrases": X.replace_phrases, "gazetteer": X.apply_gazetteer, "digits": X.fix_digits, "date": X.clean_date,
    "id": X.clean_id, "name": X.clean_name, "gender": X.canon_gender, "nationality": X.canon_nationality, "address": X.clean_address, "labels": X.strip_labels,
    "mojibake": X.repair_mojibake, "null_tokens": X.null_tokens,
}


def clean_columns(df: DataFrame, spec: dict[str, list[tuple]]) -> tuple[DataFrame, DataFrame]:
    """``df`` with the rules of each column applied in order, and a report.

    spec: column name to a list of (rule name, *arguments). The report has one row per
    column and rule: column_name, step (from 1), rule, rows, changed (value differs, null
    or not), nulled (a value became null). Nulls stay null where the rule keeps them; an
    empty table reports zeros. Other columns stay as they are. Cleaning is one projection,
    the report one aggregation over the input.
    """
    unknown = {r[0] for rules in spec.values() for r in rules} - set(RULES)
    if unknown or set(spec) - set(df.columns):
        raise ValueError(f"unknown rules or columns: {sorted(unknown | (set(spec) - set(df.columns)))}")
    steps: dict[str, list[str]] = {c: [c] for c in spec}
    wide = df
    for c, rules in spec.items():
        for n, (rule, *how) in enumerate(rules, 1):
            name = f"__{c}_{n}"
            wide = wide.withColumn(name, RULES[rule](F.col(steps[c][-1]), *how))
            steps[c].append(name)
    clean = wide.select(*(F.col(steps[c][-1]).alias(c) if c in spec else F.col(c) for c in df.columns))

    def line(c: str, n: int) -> Column:
        old, new = F.col(steps[c][n - 1]), F.col(steps[c][n])
        return F.struct(
            F.lit(c).alias("column_name"), F.lit(n).alias("step"), F.lit(spec[c][n - 1][0]).alias("rule"), F.count("*").alias("rows"),
            F.count_if(~old.eqNullSafe(new)).alias("changed"), F.count_if(old.isNotNull() & new.isNull()).alias("nulled"),
        )

    lines = [line(c, n) for c in spec for n in range(1, len(spec[c]) + 1)]
    return clean, wide.agg(F.array(*lines).alias("lines")).select(F.inline("lines"))
