"""Record fusion: competing readings of a field to one value with provenance.

candidates(doc_id, field, source, value) with the sources RAW_TEXT_RECOVERY,
FULL_CARD_OCR and FIELD_OCR. Everything is keyed by (doc_id, field), so work spreads
evenly; dictionaries are literal maps of a few dozen entries.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pergament.functions import tables as T
from pergament.functions import text as X
from pergament.operators.dictionary import by_value, dictionary, looked_up, under_rules
from pergament.sources.scratch import stored, stored_by


def priority_table(spark, priorities=T.PRIORITIES) -> DataFrame:
    rows = [(f, s, k) for f, order in priorities.items() for k, s in enumerate(order)]
    return spark.createDataFrame(rows, "field string, source string, rank int")


def literal_map(d: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in d.items() for x in kv))


# ---- F1


def merge_two(df: DataFrame, first: str = "field_value", second: str = "full_value") -> DataFrame:
    """F1. Field reading first, whole-card reading second, else null; adds value and source."""
    a, b = X.null_tokens(first), X.null_tokens(second)
    source = F.when(a.isNotNull(), "FIELD_OCR").when(b.isNotNull(), "FULL_CARD_OCR").otherwise("NOT_FOUND")
    return df.withColumns({"value": F.coalesce(a, b), "source": source})


# ---- F2

RULES = {
    "idNumber": lambda v: X.clean_id(v, "fusion"), "fullName": lambda v: X.clean_name(v, "fusion"), "dateOfBirth": lambda v: X.clean_date(v, "fusion"), "dateOfExpiry": lambda v: X.clean_date(v, "fusion"),
    "gender": lambda v: X.canon_gender(v, "fusion"), "nationality": lambda v: X.canon_nationality(v, "fusion"),
    "placeOfOrigin": lambda v: X.let(X.clean_address(v, "fusion"), lambda a: F.when(X.is_valid_address(a, True), a)),
    "placeOfResidence": lambda v: X.let(X.clean_address(v, "fusion"), lambda a: F.when(X.is_valid_address(a), a)),
}


#: The earlier rules: three fields are cleaned, the others taken as they are.
RULES_V1 = {"fullName": RULES["fullName"], "dateOfBirth": lambda v: X.clean_date(v, "fusion_v1"), "nationality": lambda v: X.canon_nationality(v, "v1")}


def clean_candidates(candidates: DataFrame, rules=RULES, recovered: bool = True) -> DataFrame:
    """Each value under its field's rule, those of other fields as they are; rows without a value left go.

    recovered: readings of raw text are taken as recovered already and stay. A rule runs
    once for each distinct value of its field, and each field's values in a branch of
    their own, so that no row passes the rules of other fields.
    """
    rule_of = F.when(F.col("field").isin(*rules), F.col("field")).otherwise("")
    if recovered:
        rule_of = F.when(F.col("source") == "RAW_TEXT_RECOVERY", "").otherwise(rule_of)
    rows = candidates.where(X.filled(F.col("value"))).withColumn("__rule", F.coalesce(rule_of, F.lit(""))).withColumnRenamed("value", "__read")

    made = lambda values: under_rules(values, "__rule", "__read", rules, X.filled)
    ruled = by_value(rows.where("__rule <> ''"), ["__rule", "__read"], made, "cleaned")
    return ruled.unionByName(rows.where("__rule = ''").withColumn("value", F.col("__read"))).select(*candidates.columns)


def fuse_v1(candidates: DataFrame) -> DataFrame:
    """F2 by the earlier priority table and rules: the field reading first, raw text cleaned like the others."""
    return ranked(candidates, clean_candidates(candidates, RULES_V1, recovered=False), T.PRIORITIES_V1)


def fuse(candidates: DataFrame, priorities=T.PRIORITIES, clean: bool = True) -> DataFrame:
    """F2. (doc_id, field, value, source) for every document and field; NOT_FOUND where nothing is valid.

    The order of the sources is a table by field. Ranked aggregation (min_by) combines
    before the shuffle, so no window over candidates is needed.
    """
    return ranked(candidates, clean_candidates(candidates) if clean else candidates.where("value <> ''"), priorities)


def ranked(candidates: DataFrame, valid: DataFrame, priorities) -> DataFrame:
    """F2 of cleaned readings, for every document of ``candidates``."""
    places = valid.join(F.broadcast(priority_table(candidates.sparkSession, priorities)), ["field", "source"])
    best = places.groupBy("doc_id", "field").agg(F.min_by(F.struct("value", "source"), F.struct("rank", "value")).alias("b"))
    domain = candidates.select("doc_id").distinct().select("doc_id", F.explode(F.array(*map(F.lit, T.FIELDS))).alias("field"))
    joined = domain.hint("merge").join(best.hint("merge"), ["doc_id", "field"], "left")
    return joined.select("doc_id", "field", F.col("b.value").alias("value"), F.coalesce("b.source", F.lit("NOT_FOUND")).alias("source"))


def to_records(fused: DataFrame) -> DataFrame:
    """One wide row per document: eight fields and a map of sources."""
    pick = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    sources = F.map_from_arrays(F.array(*map(F.lit, T.FIELDS)), F.array(*(pick(f, "source") for f in T.FIELDS)))
    return fused.groupBy("doc_id").agg(*(pick(f, "value").alias(f) for f in T.FIELDS), sources.alias("sources"))


# ---- F3 to F5


def by_document(agreed: DataFrame, value: str) -> DataFrame:
    """(doc_id, known): the rows (doc_id, k, value) of a document as one map, so that they are met by document alone."""
    return agreed.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("k", value))).alias("known"))


def told(k: Column | str) -> Column:
    return F.try_element_at(F.col("known"), X.col(k))


def richest_equivalent(candidates: DataFrame, priorities=T.PRIORITIES, field: str = "fullName") -> DataFrame:
    """F3. Of the readings with the winner's folded key, the one with most accents (ties: the earlier source)."""
    places = candidates.where(F.col("field") == field).where("value <> ''").join(F.broadcast(priority_table(candidates.sparkSession, priorities)), ["field", "source"])
    places = places.withColumns({"key": X.key("value", "name"), "score": X.diacritic_score("value")})
    by_key = places.groupBy("doc_id", "key").agg(F.min("rank").alias("first"), F.max_by(F.struct("value", "source"), F.struct("score", -F.col("rank"))).alias("b"))
    best = by_key.groupBy("doc_id").agg(F.min_by("b", "first").alias("b"))
    return best.select("doc_id", F.col("b.value").alias("value"), F.col("b.source").alias("source"))


def reconcile_disputed(names: DataFrame, alternatives: DataFrame, canon: dict[str, str] | None = None) -> DataFrame:
    """F4. First word replaced by the dictionary's spelling where two or more spellings share its folded form.

    names(doc_id, value), alternatives(doc_id, value). One spelling alone is never changed.
    """
    canon = canon or T.DISPUTED_SURNAMES
    first = F.element_at(F.split(F.col("value"), r"\s+"), 1)
    spelt = alternatives.where("value <> ''").select("doc_id", F.upper(X.fold(first)).alias("k"), F.upper(first).alias("s"))
    several = spelt.where(F.col("k").isin(*canon)).groupBy("doc_id", "k").agg(F.count_distinct("s").alias("n")).where("n >= 2")
    keyed = names.withColumn("k", F.upper(X.fold(first)))
    joined = keyed.hint("merge").join(by_document(several, "n").hint("merge"), "doc_id", "left")
    fixed = F.concat(F.try_element_at(literal_map(canon), F.col("k")), F.regexp_extract("value", r"^\S+(.*)$", 1))
    return joined.select("doc_id", F.when(told("k").isNotNull(), fixed).otherwise(F.col("value")).alias("value"))


def restore_by_context(df: DataFrame, name: str = "fullName", gender: str = "gender") -> DataFrame:
    """F5. First word by the surname map, later words by the map of the record's gender; none without a gender."""
    g, first, female, male = F.col(gender), literal_map(T.SURNAMES), literal_map(T.FEMALE_NAMES), literal_map(T.MALE_NAMES)

    def word(w: Column, i: Column) -> Column:
        k = F.upper(X.fold(w))
        later = F.when(g == T.FEMALE, F.try_element_at(female, k)).when(g == T.MALE, F.try_element_at(male, k))
        return F.coalesce(F.when(i == 0, F.try_element_at(first, k)).otherwise(later), w)

    restored = F.array_join(F.transform(F.split(X.squeeze(name), " "), word), " ")
    return df.withColumn(name, F.when(g.isNotNull() & (g != "") & F.col(name).isNotNull(), restored).otherwise(F.col(name)))


# ---- F6, F7

ENDS = " ,.;:/-"


def restore_components(primary: DataFrame, alternatives: DataFrame) -> DataFrame:
    """F6. A component without accents takes the one accented spelling that alternatives with its key agree on.

    primary(doc_id, value) gives the order; alternatives(doc_id, value). A document's
    components are looked up by key, nothing is compared pairwise.
    """
    part = F.transform(F.split("value", "[,;]"), lambda p: X.strip_chars(p, ENDS))
    own = primary.select("doc_id", F.posexplode(part).alias("at", "piece")).where("piece <> ''").withColumn("k", X.key("piece", "component"))
    other = alternatives.select("doc_id", F.explode(part).alias("spelling")).where("spelling <> ''").withColumn("k", X.key("spelling", "component"))
    other = other.where((F.col("k") != "") & (X.diacritic_score("spelling") > 0))
    agreed = other.groupBy("doc_id", "k").agg(F.count_distinct(F.lower("spelling")).alias("n"), F.max("spelling").alias("spelling")).where("n = 1")
    joined = own.hint("merge").join(by_document(agreed, "spelling").hint("merge"), "doc_id", "left")
    piece = F.when((X.diacritic_score("piece") == 0) & told("k").isNotNull(), told("k")).otherwise(F.col("piece"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", piece.alias("p")))), lambda s: s.p), ", ")
    return joined.groupBy("doc_id").agg(text.alias("value"))


CONFUSED = ("8015", "bois")  # fixed values: digits and the letters they are read for


def repair_identifiers(primary: DataFrame, alternatives: DataFrame) -> DataFrame:
    """F7. An all-digit word is replaced by the one mixed letter-digit word with its confusion key."""
    tokens = alternatives.select("doc_id", F.explode(F.regexp_extract_all("value", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("t"))
    mixed = tokens.where(F.col("t").rlike(r"\p{N}") & F.col("t").rlike(r"\p{L}")).withColumn("k", F.translate(F.lower(X.fold("t")), *CONFUSED))
    agreed = mixed.groupBy("doc_id", "k").agg(F.count_distinct("t").alias("n"), F.max("t").alias("t")).where("n = 1")
    pieces = F.regexp_extract_all("value", F.lit(r"\p{N}+(?![\p{L}\p{N}])|[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    own = primary.select("doc_id", F.posexplode(pieces).alias("at", "w")).withColumn("k", F.when(F.col("w").rlike("^[0-9]+$"), F.translate("w", *CONFUSED)))
    joined = own.hint("merge").join(by_document(agreed, "t").hint("merge"), "doc_id", "left")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce(told("k"), F.col("w")).alias("p")))), lambda s: s.p), "")
    return joined.groupBy("doc_id").agg(text.alias("value"))


def named(readings: DataFrame) -> DataFrame:
    """Distinct (names, sex) with the name that F3 to F5 make of them and its source."""
    one = stored(readings.withColumn("doc_id", F.monotonically_increasing_id()), "names")
    rows = one.select("doc_id", F.lit("fullName").alias("field"), F.inline("names"))
    best = richest_equivalent(rows)
    spelt = reconcile_disputed(best.select("doc_id", "value"), rows.select("doc_id", "value")).withColumnRenamed("value", "name")
    found = one.hint("merge").join(best.drop("value").hint("merge"), "doc_id").hint("merge").join(spelt.hint("merge"), "doc_id")
    return restore_by_context(found, "name", "sex").select("names", "sex", "name", F.col("source").alias("name_source"))


def placed(field: str) -> Callable[[DataFrame], DataFrame]:
    """Distinct (own value, readings) of a place with what F6 to F8 make of them."""

    def work(readings: DataFrame) -> DataFrame:
        one = stored(readings.withColumn("doc_id", F.monotonically_increasing_id()), "places")
        own, others = one.select("doc_id", F.col(f"own_{field}").alias("value")), one.select("doc_id", F.explode(f"all_{field}").alias("value"))
        fixed = repair_identifiers(restore_components(own, others), others).select("doc_id", X.apply_gazetteer("value").alias(f"new_{field}"))
        return one.hint("merge").join(fixed.hint("merge"), "doc_id").drop("doc_id")

    return work


def fuse_records(candidates: DataFrame) -> DataFrame:
    """F2 to F8 together: eight fields per document with sources.

    Raw-text values are recovered values already (operators.lines, recover forms). The
    cleaned and the fused readings are read several times, so both are written first, in
    buckets of documents: all that follows joins and groups by document without a shuffle.
    What F3 to F8 make of a document's readings of a field hangs on these alone, and sets of
    readings repeat, so each distinct set is worked out once, as a document of its own.
    """
    cleaned = stored_by(clean_candidates(candidates), "cleaned", "doc_id")
    fused = stored_by(ranked(candidates, cleaned, T.PRIORITIES), "fused", "doc_id")
    places, is_ = ("placeOfOrigin", "placeOfResidence"), lambda f: F.col("field") == f
    all_of = lambda f, c: F.array_sort(F.collect_set(F.when(is_(f), c)))
    read = cleaned.groupBy("doc_id").agg(all_of("fullName", F.struct("source", "value")).alias("names"), *(all_of(f, F.col("value")).alias(f"all_{f}") for f in places))
    own = fused.groupBy("doc_id").agg(F.coalesce(F.max(F.when(is_("gender"), F.col("value"))), F.lit("")).alias("sex"), *(F.max(F.when(is_(f), F.col("value"))).alias(f"own_{f}") for f in places))
    sets = stored_by(own.hint("merge").join(read.hint("merge"), "doc_id"), "readings", "doc_id")
    made = sets
    for keys, work in ((["names", "sex"], named), *(([f"own_{f}", f"all_{f}"], placed(f)) for f in places)):
        made = looked_up(made, dictionary(sets, keys, work, "sets"), keys, "left")
    made = made.select("doc_id", "name", "name_source", *(f"new_{f}" for f in places))
    records = to_records(fused).hint("merge").join(made.hint("merge"), "doc_id", "left")
    sources = F.transform_values("sources", lambda k, v: F.when(k == "fullName", F.coalesce("name_source", F.lit("NOT_FOUND"))).otherwise(v))
    records = records.withColumns({"sources": sources, "fullName": F.col("name"), **{f: F.col(f"new_{f}") for f in places}})
    return records.select("doc_id", *T.FIELDS, "sources")
