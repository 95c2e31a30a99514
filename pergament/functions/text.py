"""Text repair, accent folding and field cleaning as column expressions.

Everything runs in the JVM; the only Python is ``nfkc`` for rows that hold characters
outside the stable classes, ``repair_mojibake`` for rows with box-drawing letters and the
gestalt ratio, which the operators give distinct pairs that may reach their threshold.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from pergament.functions import tables as T
from pergament.functions.blocks import ratios

LETTER = r"[A-Za-z\u00C0-\u1EF9]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(c: Column | str, f) -> Column:
    """f of a value that is computed once, however often f uses it; keeps generated code small."""
    return F.get(F.transform(F.array(col(c)), f), F.lit(0))


def kept(df: DataFrame, name: str, value: Column, test) -> DataFrame:
    """``df`` with the column ``name``, and only the rows whose value passes ``test`` (of a column).

    The value is computed once a row: a filter on a computed column would be moved below it
    and compute it again.
    """
    return df.withColumn(name, F.explode(F.filter(F.array(value), test)))


def filled(c: Column) -> Column:
    """Neither null nor empty."""
    return c.isNotNull() & (c != "")


# ---- T2: folding


@lru_cache(1)
def fold_table() -> tuple[str, str]:
    """Composed letters whose decomposition holds a combining mark, and their bases; the barred d too."""
    src, dst = ["đ", "Đ"], ["d", "D"]
    for c in map(chr, range(0xC0, 0x2000)):
        parts = unicodedata.normalize("NFD", c)
        base = [p for p in parts if unicodedata.category(p) != "Mn"]
        if len(parts) > 1 and len(base) == 1 and len(base) < len(parts):
            src.append(c)
            dst.append(base[0])
    return "".join(src), "".join(dst)


def fold_plain(text: str) -> str:
    """The same for a Python string, for small dictionaries."""
    parts = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    return parts.replace("đ", "d").replace("Đ", "D")


def fold(c: Column | str) -> Column:
    """Letters without accents (T2). Combining marks go, the barred d becomes d; length else kept."""
    src, dst = fold_table()
    return F.regexp_replace(F.translate(col(c), src, dst), r"\p{Mn}", "")


def key(c: Column | str, kind: str = "anchor") -> Column:
    """Comparison keys of folded text: anchor, compact, alnum, plain, name, component."""
    c = col(c)
    if kind == "anchor":
        return F.trim(F.regexp_replace(F.lower(fold(c)), "[^a-z0-9]+", " "))
    if kind == "compact":
        return F.regexp_replace(F.lower(fold(c)), "[^a-z0-9]+", "")
    if kind == "alnum":  # accents stay
        return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    if kind == "plain":
        return squeeze(F.regexp_replace(F.lower(fold(c)), r"[^a-z0-9/,;:\-\s]", " "))
    if kind == "name":
        return squeeze(F.upper(fold(c)))
    if kind == "component":
        return F.trim(F.regexp_replace(F.lower(fold(c)), "[^a-z0-9]+", " "))
    raise ValueError(f"unknown key kind {kind!r}")


def squeeze(c: Column | str) -> Column:
    """Runs of white space to one space, ends trimmed."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def strip_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


@lru_cache(1)
def accented() -> dict[str, str]:
    src, dst = fold_table()
    found: dict[str, str] = {}
    for s, d in zip(src, dst):
        if s.lower() == s and d.isascii():
            found[d.lower()] = found.get(d.lower(), "") + s
    return found


def tolerant(pattern: str) -> str:
    """A pattern on folded text as a case-insensitive pattern on the original text.

    Every literal letter also stands for its accented forms, composed or with marks behind
    it, so replacing keeps the accents of everything around the match.
    """
    variants, out, k, inside = accented(), [], 0, False
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            out.append(pattern[k : k + 2])
            k += 2
            continue
        if c == "[":
            inside = True
        elif c == "]":
            inside = False
        if inside and pattern[k + 1 : k + 2] == "-" and c.isalnum():
            out.append(pattern[k : k + 3])
            k += 3
            continue
        if c.isalpha() and c.isascii() and not (c == "?" or pattern[k - 1 : k] == "?" and pattern[k - 2 : k - 1] == "("):
            own = c.lower() + variants.get(c.lower(), "")
            out.append(own if inside else f"[{own}]\\p{{Mn}}*")
        else:
            out.append(c)
        k += 1
    return "(?iuU)" + "".join(out)


# ---- T3, F8: ordered phrases


ASCII = r"^\p{ASCII}*$"


def replace_tolerant(c: Column, pattern: str, new: str, flags: str = "") -> Column:
    """One accent- and case-insensitive replacement; ASCII text takes the plain, much cheaper pattern."""
    plain = F.regexp_replace(c, f"(?i{flags})" + pattern, new)
    return F.when(c.rlike(ASCII), plain).otherwise(F.regexp_replace(c, (f"(?{flags})" if flags else "") + tolerant(pattern), new))


def some_phrase(phrases: tuple[tuple[str, str], ...]) -> str:
    """One pattern that every folded text with a phrase fits; looked for at word starts with a right first letter."""
    bare = [p.removeprefix(r"\b").replace(r"\b", "") for p, _ in phrases]
    return r"(?i)\b(?=[" + "".join(sorted({p[0] for p in bare})) + "])(?:" + "|".join(bare) + ")"


def literal_sql(text: str) -> str:
    """A text as a SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@lru_cache(8)
def ordered_sql(phrases: tuple[tuple[str, str], ...]) -> str:
    """The replacements of ``replace_ordered`` as a SQL lambda: one expression to parse, where columns would be thousands of calls."""

    def chain(form) -> str:
        return reduce(lambda y, p: f"regexp_replace({y}, {literal_sql(form(p[0]))}, {literal_sql(p[1].replace(chr(92), chr(92) * 2).replace('$', chr(92) + '$'))})", phrases, "phrase_of")

    folded = "regexp_replace(translate(phrase_of, {}, {}), {}, '')".format(*map(literal_sql, (*fold_table(), r"\p{Mn}")))
    return f"phrase_of -> CASE WHEN NOT {folded} RLIKE {literal_sql(some_phrase(phrases))} THEN phrase_of WHEN phrase_of RLIKE {literal_sql(ASCII)} THEN {chain(lambda p: '(?i)' + p)} ELSE {chain(tolerant)} END"


def replace_ordered(c: Column | str, phrases: tuple[tuple[str, str], ...]) -> Column:
    """Replace accent- and case-insensitive patterns in their order, the text around them untouched.

    One alternation of all patterns on the folded text decides first, so most rows skip the
    chain; ASCII text takes plain patterns, which are many times cheaper than tolerant ones.
    """
    return F.get(F.call_function("transform", F.array(col(c)), F.expr(ordered_sql(phrases))), F.lit(0))


def replace_phrases(c: Column | str) -> Column:
    """Card labels that were read glued or misspelt to their canonical form (T3)."""
    return replace_ordered(c, T.PHRASES)


def apply_gazetteer(c: Column | str) -> Column:
    """Known place phrases to their spelling, longer ones first (F8)."""
    return replace_ordered(c, T.PLACES)


# ---- T1: normalising


@lru_cache(1)
def unstable() -> str:
    """Character class of what NFKC changes (below U+3100 by listing, beyond by block), for rlike."""
    points = [n for n in range(0x3100) if unicodedata.normalize("NFKC", chr(n)) != chr(n) or unicodedata.combining(chr(n))]
    runs, start = [], None
    for a, b in zip(points, [*points[1:], None]):
        start = a if start is None else start
        if b != a + 1:
            runs.append(f"\\x{{{start:X}}}-\\x{{{a:X}}}" if start != a else f"\\x{{{a:X}}}")
            start = None
    return "[" + "".join(runs) + r"\x{3100}-\x{33FF}\x{A600}-\x{ABFF}\x{AC00}-\x{D7FF}\x{F900}-\x{FFEF}\x{10000}-\x{1FFFF}\x{2F800}-\x{2FA1F}]"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(c: Column | str) -> Column:
    """NFKC form; only rows with an unstable character are changed in Python. ASCII text, which has none, skips the long pattern."""
    c = col(c)
    odd = ~c.rlike(ASCII) & c.rlike(unstable())
    return F.when(odd, _nfkc(F.when(odd, c))).otherwise(c)


def join_dates(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)(?<=\d)\s*/\s*(?=\d)", "/")


def space_slashes(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?<={LETTER})(?U:\s*)/(?U:\s*)(?={LETTER})", " / ")


def normalize_text(c: Column | str, compose: bool = True) -> Column:
    """T1. Null text: empty. Control characters go before white space is squeezed, so a tab joins words.

    compose=False leaves NFKC out where the text is known to be composed already.
    """
    c = F.coalesce(col(c), F.lit(""))
    return let(nfkc(c) if compose else c, _normalized)


def _normalized(c: Column) -> Column:
    return F.when(c.rlike(ASCII), _normalized_ascii(c)).otherwise(_normalized_any(c))


def _normalized_any(c: Column) -> Column:
    c = F.translate(c, "_|\u2013\u2014", " /--")
    c = squeeze(F.regexp_replace(c, r"\p{C}", ""))
    c = F.regexp_replace(c, r"(?U)\s+([,.:;])", "$1")
    c = F.regexp_replace(c, r"([,:;])(?=[A-Za-z\u00C0-\u1EF90-9])", "$1 ")
    c = space_slashes(join_dates(c))
    c = replace_phrases(c)
    return squeeze(space_slashes(join_dates(c)))


CONTROLS = "".join(map(chr, [*range(32), 127]))


def _normalized_ascii(c: Column) -> Column:
    """The same for ASCII text, whose only white space is the space once control characters are gone."""

    def spaced(x: Column) -> Column:
        return F.trim(F.when(F.contains(x, F.lit("  ")), F.regexp_replace(x, "  +", " ")).otherwise(x))

    def slashes(x: Column) -> Column:
        joined = F.regexp_replace(x, r"(?<=\d) */ *(?=\d)", "/")
        return F.when(F.contains(x, F.lit("/")), F.regexp_replace(joined, r"(?<=[A-Za-z]) */ *(?=[A-Za-z])", " / ")).otherwise(x)

    bare = let(F.translate(c, "_|" + CONTROLS, " /"), spaced)
    parted = F.regexp_replace(F.regexp_replace(bare, " ([,.:;])", "$1"), r"([,:;])(?=[A-Za-z0-9])", "$1 ")
    return let(let(parted, slashes), lambda x: F.when(~x.rlike(some_phrase(T.PHRASES)), spaced(x)).otherwise(squeeze(space_slashes(join_dates(replace_phrases(x))))))


# ---- T5: digits


def fix_digits(c: Column | str, profile: str = "fusion") -> Column:
    """Letters read for digits: fusion, field (also i, L), layout (upper-cased; S, B), dates (field and h for /)."""
    c = col(c)
    if profile == "fusion":
        return F.translate(c, "OoIl|", "00111")
    if profile == "field":
        return F.translate(c, "OoIiLl", "001111")
    if profile == "layout":
        return F.translate(F.upper(c), "OILSB", "01158")
    if profile == "dates":
        return F.translate(c, "OoIilh", "00111/")
    raise ValueError(f"unknown digit profile {profile!r}")


# ---- T6: dates


def date_of(day: Column, month: Column, year: Column) -> Column:
    return F.concat_ws("/", F.lpad(day, 2, "0"), F.lpad(month, 2, "0"), year)


def real_date(c: Column, low: int = 1, high: int = 9999) -> Column:
    """The DD/MM/YYYY string where it is a calendar date within the years, else null."""
    return let(c, lambda x: F.when(let(F.year(F.try_to_date(x, "d/M/yyyy")), lambda y: y.between(low, high)), x))


def eight(digits: Column) -> Column:
    return F.concat_ws("/", F.substring(digits, 1, 2), F.substring(digits, 3, 2), F.substring(digits, 5, 4))


def parts_of(c: Column, pattern: str) -> tuple[Column, Column, Column]:
    return tuple(F.regexp_extract(c, pattern, k) for k in (1, 2, 3))


def clean_date(c: Column | str, profile: str = "fusion") -> Column:
    """T6. DD/MM/YYYY or null.

    fusion: digits repaired, calendar-checked, 1900-2100; eight digits in a row, and nine
    with one too many (adjacent duplicates tried first). field: h is a slash, calendar-checked.
    layout: bounded (1900-2199) but not calendar-checked; eight digits as they are. line:
    bounded, year from 1900. expiry: calendar-checked, / or -. legacy: in-text repair, unchecked.
    """
    return let(c, lambda x: _date(x, profile))


def _date(c: Column, profile: str) -> Column:
    if profile == "fusion":
        text = F.regexp_replace(fix_digits(c, "fusion"), r"(?U)\s+", "")
        return let(text, _fusion_date)
    if profile == "field":
        return let(fix_digits(c, "dates"), _field_date)
    if profile == "layout":
        return let(F.regexp_replace(F.translate(F.trim(c), ".-\\", "///"), r"(?U)\s*/\s*", "/"), _layout_date)
    if profile in ("line", "expiry"):
        return let(F.regexp_extract(c, r"\b\d{1,2}[/-]\d{1,2}[/-]\d{4}\b", 0), lambda x: F.when(x != "", _line_date(x, profile)))
    if profile == "legacy":
        text = F.translate(c, "OoIl", "0011")
        text = F.regexp_replace(text, r"(\d{2})/(\d{2})1(\d{4})", "$1/$2/$3")
        text = F.regexp_replace(text, r"(\d{2})/(\d{2})(\d{4})", "$1/$2/$3")
        found = F.regexp_extract(text, r"\b\d{2}/\d{2}/\d{4}\b", 0)
        return F.when(found != "", found)
    if profile == "fusion_v1":
        runs = F.regexp_extract_all(fix_digits(c, "fusion"), F.lit(r"\d{8,9}"), F.lit(0))
        more = F.filter(F.transform(runs, compact_date), lambda t: t.isNotNull())
        return F.coalesce(_date(c, "fusion"), F.get(more, F.lit(0)))
    raise ValueError(f"unknown date profile {profile!r}")


def _line_date(found: Column, profile: str) -> Column:
    """Of day, month and year between slashes or dashes: calendar-checked (expiry), or bounded with a year from 1900 (line)."""
    p = F.split(found, "[/-]")

    def bounded(x: Column) -> Column:
        return F.when(F.substring(x, 1, 2).between("01", "31") & F.substring(x, 4, 2).between("01", "12") & (F.substring(x, 7, 4) >= "1900"), x)

    whole = let(p, lambda q: date_of(q[0], q[1], q[2]))
    return real_date(whole) if profile == "expiry" else let(whole, bounded)


def compact_date(digits: Column) -> Column:
    """The date of eight digits, or of nine of which one is too many."""

    def without(k: Column) -> Column:
        return F.concat(F.substring(digits, F.lit(1), k - 1), F.substring(digits, k + 1, F.lit(9)))

    twice = F.filter(F.sequence(F.lit(1), F.lit(8)), lambda k: F.substring(digits, k, F.lit(1)) == F.substring(digits, k + 1, F.lit(1)))
    tries = F.transform(F.concat(twice, F.sequence(F.lit(1), F.lit(9))), without)
    good = F.filter(F.transform(tries, lambda t: real_date(eight(t), 1900, 2100)), lambda t: t.isNotNull())
    return F.when(F.length(digits) == 8, real_date(eight(digits), 1900, 2100)).when(F.length(digits) == 9, F.get(good, F.lit(0)))


def _fusion_date(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?<!\d)\d{1,2}[./\\-]\d{1,2}[./\\-]\d{4}(?!\d)", 0)
    parted = let(F.split(found, r"[./\\-]"), lambda q: F.when(F.size(q) == 3, date_of(q[0], q[1], q[2])))
    return F.coalesce(real_date(parted, 1900, 2100), let(F.regexp_replace(text, r"\D", ""), compact_date))


def _field_date(text: Column) -> Column:
    d, m, y = parts_of(text, r"(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})")
    digits = F.regexp_replace(text, r"\D", "")
    return F.when(d != "", real_date(date_of(d, m, y))).when(F.length(digits) == 8, real_date(eight(digits)))


def _layout_date(text: Column) -> Column:
    d, m, y = parts_of(text, r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b")
    digits = F.regexp_replace(text, r"\D", "")
    inside = F.lpad(d, 2, "0").between("01", "31") & F.lpad(m, 2, "0").between("01", "12") & y.between("1900", "2199")
    return F.when(d != "", F.when(inside, date_of(d, m, y))).when(F.length(digits) == 8, eight(digits))


# ---- T7: identifiers


def clean_id(c: Column | str, profile: str = "fusion") -> Column:
    """T7. First twelve digits after repair and removal of anything else, else null.

    field: exactly twelve digits. layout: shorter digit strings are given back as they are.
    """
    digits = F.regexp_replace(fix_digits(c, profile), r"\D", "")
    found = F.regexp_extract(digits, r"^\d{12}$" if profile == "field" else r"\d{12}", 0)
    return F.when(found != "", found).otherwise(digits if profile == "layout" else F.lit(None))


# ---- T8: names


def before_label(c: Column, label: str = T.STOP_LABEL) -> Column:
    """Text up to the first known label."""
    return replace_tolerant(c, label + ".*$", "", "s")


def clean_name(c: Column | str, profile: str = "fusion") -> Column:
    """T8. Upper-case name or null: fusion, line, field, layout, legacy."""
    return let(c, lambda x: _clean_name(x, profile))


def _clean_name(c: Column, profile: str) -> Column:
    if profile in ("fusion", "line"):
        if profile == "fusion":
            words = F.regexp_extract_all(before_label(c), F.lit(r"[\p{L}\p{Nl}\p{Mn}]+"), F.lit(0))
            kept = F.filter(words, lambda w: let(fold(w), lambda x: ~F.upper(x).isin(*T.NOT_NAMES) & (F.length(x) > 1)))
        else:
            text = F.regexp_replace(F.regexp_replace(c, "(?i)" + T.STOP_LABEL_LINE, " "), r"[^A-Za-z\u00C0-\u1EF9\s]", " ")
            kept = F.filter(F.split(squeeze(text), " "), lambda w: ~F.upper(w).isin(*T.NOT_NAMES_LINE) & (F.length(w) > 1))
        return let(kept, lambda k: F.when(F.size(k).between(2, 7), F.upper(F.array_join(k, " "))))
    if profile == "field":
        words = F.regexp_extract_all(c, F.lit(r"[\p{L}\p{Nl}]+"), F.lit(0))
        return let(words, lambda w: F.when((F.length(F.array_join(w, " ")) >= 3) & (F.size(w) >= 2), F.upper(F.array_join(w, " "))))
    if profile == "layout":
        text = strip_labels(c, "fullName", "prefix")
        return strip_chars(squeeze(F.regexp_replace(text, r"[^A-Za-z\u00C0-\u1EF9Đđ\s'-]", " ")), " :-/")
    if profile == "legacy":
        return F.upper(squeeze(F.regexp_replace(c, r"[^A-Za-z\u00C0-\u1EF9\s]", "")))
    raise ValueError(f"unknown name profile {profile!r}")


# ---- T9, T10: categories


def canon_gender(c: Column | str, profile: str = "fusion") -> Column:
    """T9. One of two values or null; whole words only, so a country name is no gender.

    layout and legacy look for substrings too; layout gives other text back squeezed.
    """
    return let(c, lambda x: _canon_gender(x, profile))


def _canon_gender(c: Column, profile: str) -> Column:
    if profile in ("fusion", "field"):
        word = F.regexp_replace(F.lower(fold(c)), "[^a-z]", "")
        female = T.FEMALE_WORDS if profile == "fusion" else [w for w in T.FEMALE_WORDS if w != "nuu"]
        return F.when(word.isin(*female), T.FEMALE).when(word.isin(*T.MALE_WORDS), T.MALE)
    if profile == "layout":
        word = F.regexp_replace(F.lower(strip_labels(c, "gender", "prefix")), r"[^a-z\u00E0-\u1EF9đ]", "")
        return (
            F.when(word.isin("nam", "male"), T.MALE).when(word.isin("nu", "nữ", "female") | word.contains("female"), T.FEMALE)
            .when(word.contains("male"), T.MALE).when(word.contains("nu"), T.FEMALE).when(word.contains("nam"), T.MALE).otherwise(squeeze(c))
        )
    if profile == "legacy":
        up = F.upper(c)
        return F.when(up.rlike(r"(?U)\bNAM\b"), T.MALE).when(up.contains("NU") | up.contains("NỮ"), T.FEMALE)
    raise ValueError(f"unknown gender profile {profile!r}")


def canon_nationality(c: Column | str, profile: str = "fusion") -> Column:
    """T10. The country's canonical name; other text null (fusion, legacy) or cleaned (field, layout)."""
    return let(c, lambda x: _canon_nationality(x, profile))


def _canon_nationality(c: Column, profile: str) -> Column:
    folded = F.lower(fold(c))
    if profile == "fusion":
        return F.when(F.regexp_replace(folded, "[^a-z]", "").rlike(T.COUNTRY_FUSION), T.COUNTRY)
    if profile == "field":
        name = F.array_join(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{Nl}]+"), F.lit(0)), " ")
        return F.when(folded.rlike(T.COUNTRY_FIELD), T.COUNTRY).otherwise(F.when(name != "", name))
    if profile == "layout":
        value = strip_chars(squeeze(strip_labels(c, "nationality", "prefix")), " :-/")
        word = F.regexp_replace(F.lower(value), "[^a-z]", "")
        return F.when(word.isin(*T.COUNTRY_LAYOUT), T.COUNTRY).otherwise(value)
    if profile == "legacy":
        up = F.upper(c)
        return F.when(up.rlike(T.COUNTRY_LEGACY), T.COUNTRY)
    if profile == "v1":
        word = F.regexp_replace(folded, "[^a-z]", "")
        return F.when(word.rlike(T.COUNTRY_FUSION) | word.isin(*T.COUNTRY_SHORT), T.COUNTRY).when(F.length(word) >= 4, squeeze(c))
    raise ValueError(f"unknown nationality profile {profile!r}")


# ---- T11: addresses

DATE_RUN = r"(?<!\d)\d{1,2}[./-]\d{1,2}[./-]\d{4}(?!\d)"


def clean_address(c: Column | str, profile: str = "fusion") -> Column:
    """T11. Pieces between , and ; without expiry labels and dates; separators joined, ends trimmed.

    fusion: what follows a labelled date in its piece is kept; empty is null. line: expiry
    label with its date removed. field: shorter than three characters is null. layout: label
    prefixes removed.
    """
    return let(c, lambda x: _clean_address(x, profile))


def _clean_address(c: Column, profile: str) -> Column:
    if profile == "fusion":
        def piece(p: Column) -> Column:
            """Nothing of a piece with an expiry label but what follows the date after it."""
            repaired = fix_digits(p, "fusion")
            tail = F.substring(p, F.length(F.regexp_extract(repaired, r"(?s)^(.*?" + DATE_RUN + ")", 1)) + 1, F.length(p))
            head = F.regexp_extract(repaired, r"(?s)^(.*?)" + DATE_RUN, 1)
            labelled = F.rlike(fold(F.substring(p, F.lit(1), F.length(head))), F.lit("(?i)" + T.EXPIRY))
            rest = F.when(repaired.rlike(DATE_RUN) & labelled, tail).otherwise("")
            return F.when(F.rlike(fold(p), F.lit("(?i)" + T.EXPIRY)), rest).otherwise(p)

        kept = F.filter(F.transform(F.split(c, "[,;]"), piece), lambda p: strip_chars(p, " :/-") != "")
        text = F.array_join(kept, ", ")
        labels = f"(?:que\\s*quan|{T.ORIGIN_EN}|{T.RESIDENCE_VI}|{T.RESIDENCE_EN}|{T.EXPIRY})\\s*:?"
        text = let(text, lambda t: replace_tolerant(t, labels, " "))
        text = F.regexp_replace(text, r"\b\d{1,2}[./-]\d{1,2}[./-]\d{4}\b", " ")
        text = strip_chars(squeeze(F.regexp_replace(F.regexp_replace(text, r"\s*,\s*", ", "), r",(?:\s*,)+", ", ")), " ,/:;-")
        return F.when(text != "", text)
    if profile == "line":
        text = F.regexp_replace(c, "(?i)" + T.EXPIRY_WITH_DATE, " ")
        text = F.regexp_replace(F.regexp_replace(text, r"\s+([,.;])", "$1"), r"[,;]\s*[,;]+", ", ")
        return strip_chars(F.regexp_replace(text, r"\s+", " "), " ,.;:-")
    if profile == "field":
        text = F.regexp_replace(F.regexp_replace(F.translate(c, ";", ","), r"\s+([,.:])", "$1"), r",\s*,+", ", ")
        text = strip_chars(F.regexp_replace(F.regexp_replace(text, r"\s*,\s*", ", "), r"\s+", " "), " ,.;:/-")
        return F.when(F.length(text) >= 3, text)
    if profile == "layout":
        text = strip_labels(strip_labels(c, "placeOfOrigin", "prefix"), "placeOfResidence", "prefix")
        return strip_chars(squeeze(F.regexp_replace(F.regexp_replace(text, r"\s*,\s*", ", "), r"\s*;\s*", ", ")), " :-/,")
    raise ValueError(f"unknown address profile {profile!r}")


# ---- T12: labels


def quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != " " else c for c in text)


def strip_labels(c: Column | str, field: str, mode: str = "anywhere") -> Column:
    """T12. anywhere, first, prefix, after or before the labels of a field.

    after and before give an empty string where there is no label.
    """
    c = col(c)
    label = {
        "fullName": T.NAME_LABEL, "dateOfBirth": T.BIRTH_LABEL, "gender": T.GENDER_LABEL, "nationality": T.NATIONALITY_LABEL, "placeOfOrigin": T.ORIGIN_LABEL,
        "placeOfResidence": T.RESIDENCE_LABEL, "dateOfExpiry": T.EXPIRY_LABEL, "idNumber": r"\b(?:so|no)\b",
    }[field]
    if mode == "anywhere":
        return squeeze(F.regexp_replace(F.regexp_replace(c, "(?i)" + label, " "), r"^[\s:/,;.\-]+", ""))
    if mode == "first":
        rest = F.concat(F.regexp_extract(c, f"(?is)^(.*?){label}", 1), F.regexp_extract(c, f"(?is)^.*?{label}(.*)$", 1))
        rest = F.when(c.rlike("(?i)" + label), rest).otherwise(c)
        rest = F.regexp_replace(rest, "(?i)" + T.ENGLISH_HALF, "")
        return F.trim(F.regexp_replace(rest, r"^[\s:;/,-]+", ""))
    if mode == "prefix":
        return reduce(lambda x, a: F.regexp_replace(x, r"(?iu)^\s*" + quoted(a) + r"\s*[:/\-]*\s*", ""), T.ALIASES[field], F.trim(c))
    if mode == "after":
        return strip_chars(F.regexp_extract(c, f"(?is)^.*?{label}(.*)$", 1), " :;,/-")
    if mode == "before":
        return strip_chars(F.regexp_extract(c, f"(?is)^(.*?){label}", 1), " :;,/-")
    raise ValueError(f"unknown mode {mode!r}")


# ---- T13 to T15


@F.pandas_udf(StringType())
def _recode(s: pd.Series, wrong: pd.Series) -> pd.Series:
    def one(x, page):
        try:
            return x.encode(page).decode("utf-8")
        except (UnicodeError, AttributeError):
            return x

    return pd.Series([one(x, p) for x, p in zip(s, wrong)])


def repair_mojibake(c: Column | str, wrong: str = "cp437") -> Column:
    """T13. UTF-8 that was read as another code page, where the way back is valid; else unchanged."""
    c = col(c)
    odd = c.rlike(r"[\u00A0-\u00FF\u2190-\u25FF\u0370-\u03FF\u2200-\u22FF]")
    return F.when(odd, _recode(F.when(odd, c), F.lit(wrong))).otherwise(c)


def null_tokens(c: Column | str) -> Column:
    """T14. Trimmed text; empty text and the words for nothing become null."""
    c = F.trim(col(c))
    return F.when(~F.lower(c).isin(*T.NULL_WORDS), c)


@lru_cache(1)
def marks_table() -> dict[int, str]:
    """Characters by the number of combining marks in their decomposition."""
    found: dict[int, str] = {1: "đĐ"}
    for c in map(chr, range(0xC0, 0x2000)):
        n = sum(unicodedata.category(p) == "Mn" for p in unicodedata.normalize("NFD", c))
        if n:
            found[n] = found.get(n, "") + c
    return found


def diacritic_score(c: Column | str) -> Column:
    """T15. Combining marks after decomposition plus barred d."""
    c = F.coalesce(col(c), F.lit(""))
    counted = [(F.length(c) - F.length(F.translate(c, chars, ""))) * n for n, chars in marks_table().items()]
    return reduce(lambda a, b: a + b, counted)


# ---- T16: similarity


@F.pandas_udf(DoubleType())
def gestalt(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks (longest first) to both lengths, once for each distinct pair; null for a null side."""
    pairs = pd.DataFrame({"a": a, "b": b}).dropna()
    once = pairs.drop_duplicates()
    known = dict(zip(once.itertuples(index=False, name=None), ratios(once["a"].tolist(), once["b"].tolist())))
    out = pd.Series(np.nan, index=a.index, dtype="float64")
    out[pairs.index] = [known[p] for p in pairs.itertuples(index=False, name=None)]
    return out.astype(object).where(out.notna(), None)


@F.pandas_udf(DoubleType())
def best_gestalt(x: pd.Series, y: pd.Series, u: pd.Series, v: pd.Series) -> pd.Series:
    """The greater ratio of (x, y) and (u, v); null, at no cost, where x is null."""
    out = pd.Series([None] * len(x), index=x.index, dtype=object)
    some = x.notna()
    if some.any():
        out[some] = np.maximum(ratios(x[some].tolist(), y[some].tolist()), ratios(u[some].tolist(), v[some].tolist()))
    return out


def gestalt_bound(a: Column, b: Column) -> Column:
    """What no gestalt ratio of two texts exceeds: twice the shorter length over both."""
    return 2 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b))


KEY_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
LEVELS = 3


def letters(compact: Column | str) -> Column:
    """Letter counts of a compact key as bits: array(low, high, rest).

    Of each letter or digit one bit says that it is there, one that it is there twice, one
    three times; rest counts what is beyond that.
    """
    half = len(KEY_LETTERS) // 2

    def wanted(part: str) -> Column:
        bits = (f"struct('{c * n}' AS run, {1 << (k * LEVELS + n - 1)}L AS bit)" for k, c in enumerate(part) for n in range(1, LEVELS + 1))
        return F.expr(f"array({', '.join(bits)})")

    def bits(run: Column, own: Column) -> Column:
        return F.aggregate(own, F.lit(0).cast("long"), lambda m, w: F.when(F.contains(run, w["run"]), m.bitwiseOR(w["bit"])).otherwise(m))

    def packed(run: Column) -> Column:
        return let(F.array(*(bits(run, wanted(p)) for p in (KEY_LETTERS[:half], KEY_LETTERS[half:]))), lambda b: F.array(b[0], b[1], F.length(run) - F.bit_count(b[0]) - F.bit_count(b[1])))

    return let(F.array_join(F.sort_array(F.split(col(compact), "")), ""), packed)


def letters_in_common(a: Column, b: Column) -> Column:
    """At least the number of letters that two texts have in common, from their ``letters``."""
    return F.bit_count(a[0].bitwiseAND(b[0])) + F.bit_count(a[1].bitwiseAND(b[1])) + F.least(a[2], b[2])


def letters_bound(x: Column, y: Column, u: Column, v: Column, a: Column, b: Column) -> Column:
    """What neither ratio nor containment of two texts exceeds, from anchor keys x, y, compact keys u, v and their ``letters``.

    Blocks that match, the letters an edit leaves in place and a contained text all lie in
    the common letters; anchor keys may have spaces in common besides. It holds for the
    gestalt ratio and the edit ratio, up to the last digit of a double.
    """
    shared = letters_in_common(a, b)
    spaces = F.least(F.length(x) - F.length(u), F.length(y) - F.length(v))
    return F.greatest(2 * (shared + spaces) / (F.length(x) + F.length(y)), 2 * shared / (F.length(u) + F.length(v))) + 1e-9


def similarity(a: Column | str, b: Column | str, method: str = "levenshtein") -> Column:
    """T16: 1 on equal keys, 0 on empty ones, else the best of two ratios and containment.

    method: levenshtein (native) or gestalt (Python; ``operators.labels`` scores distinct pairs).
    """
    if method not in ("levenshtein", "gestalt"):
        raise ValueError(f"unknown similarity {method!r}")
    if method == "gestalt":
        return key_similarity(key(a, "anchor"), key(b, "anchor"), key(a, "compact"), key(b, "compact"), gestalt)
    keys = F.struct(key(a, "anchor").alias("x"), key(b, "anchor").alias("y"), key(a, "compact").alias("u"), key(b, "compact").alias("v"))
    return let(keys, lambda k: edit_similarity(k.x, k.y, k.u, k.v))


def edit_similarity(x: Column, y: Column, u: Column, v: Column) -> Column:
    """Similarity of two texts by their anchor keys x, y and compact keys u, v."""
    return key_similarity(x, y, u, v, lambda p, q: 1 - F.levenshtein(p, q) / F.greatest(F.length(p), F.length(q)))


def key_similarity(x: Column, y: Column, u: Column, v: Column, ratio) -> Column:
    return F.when((x == "") | (y == ""), 0.0).when((x == y) | (u == v), 1.0).otherwise(F.greatest(ratio(x, y), ratio(u, v), containment(x, y), containment(u, v)))


def containment(p: Column, q: Column) -> Column:
    inside = F.contains(p, q) | F.contains(q, p)
    return F.when(inside, F.least(F.length(p), F.length(q)) / F.greatest(F.length(p), F.length(q))).otherwise(0.0)


def is_valid_address(c: Column | str, origin: bool = False) -> Column:
    """F9. Three words or more, fewer than three of one letter, no label, no noise word; at most two digits for origins."""
    return F.coalesce(let(key(c, "plain"), lambda plain: _valid_address(plain, origin)), F.lit(False))


def _valid_address(plain: Column, origin: bool) -> Column:
    return let(F.struct(plain.alias("plain"), F.regexp_extract_all(plain, F.lit("[a-z0-9]+"), F.lit(0)).alias("words")), lambda s: _valid_words(s.plain, s.words, origin))


def _valid_words(plain: Column, words: Column, origin: bool) -> Column:
    good = (F.size(words) >= 3) & (F.size(F.filter(words, lambda w: F.length(w) == 1)) < 3) & ~F.arrays_overlap(words, F.array(*map(F.lit, T.NOISE_WORDS)))
    good &= ~reduce(lambda x, y: x | y, (plain.contains(x) for x in T.NOT_ADDRESS_LABELS))
    if origin:
        good &= F.length(F.regexp_replace(plain, "[^0-9]", "")) <= 2
    return good


def is_valid_name(c: Column | str) -> Column:
    """F10, the earlier rule: two to eight words, at least two of them no label words."""
    words = F.filter(F.split(key(c, "name"), " "), lambda w: w != "")
    free = F.filter(words, lambda w: ~F.array_contains(F.array(*map(F.lit, T.NOT_NAMES)), w))
    return F.coalesce(F.size(words).between(2, 8) & (F.size(free) >= 2), F.lit(False))
