"""Mechanisms for large inputs, each equal to its plain form: batched ratios, letter bounds, dictionaries, cells, sweeps."""

import random
import re
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest
from pergament.functions import blocks, trie
from pergament.functions import text as X
from pergament.operators import boxes as B
from pergament.operators import dictionary as D
from pergament.operators import fusion as Fu
from pergament.operators import labels as A
from pergament.operators import lines as L
from pergament.operators import quality as Q
from pergament.plans import box_queries as Q_boxes
from pergament.plans import text_queries as TQ
from pergament.plans import views as V
from pyspark.sql import functions as F

BOX = "doc_id long, box_id long, text string, left double, top double, right double, bottom double, confidence double"


def words(rng, letters, longest, n):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("letters,longest,n", [("ab", 14, 12_000), ("abcdefgh ", 30, 20_000), ("abcdefghijklmnopqrstuvwxyz0123456789 ", 40, 20_000), ("aé😀\x00b", 15, 6_000), ("abc", 320, 300)])
def test_batched_ratio_equals_the_standard_library(letters, longest, n):
    rng = random.Random(len(letters))
    a, b = words(rng, letters, longest, n), words(rng, letters, longest, n)
    for x, y in ((a, b), (b, a)):
        assert blocks.ratios(x, y).tolist() == [SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)]


def test_gestalt_columns_pass_nulls(spark):
    rows = [("abc", "abd"), (None, "x"), ("x", None), ("", ""), ("abc", "abd")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(X.gestalt("a", "b")).collect()]
    assert got == [SequenceMatcher(None, "abc", "abd").ratio(), None, None, 1.0, SequenceMatcher(None, "abc", "abd").ratio()]


@pytest.mark.parametrize("method", ["gestalt", "levenshtein"])
def test_letter_bound_loses_no_label(spark, method):
    """All pairs of odd texts with all aliases, scored one by one."""
    rng = random.Random(3)
    aliases = A.label_table(spark).collect()
    texts = {r["alias"] for r in aliases} | set(words(rng, "abeghinoqrstuy  aa", 22, 600)) | {"Số", "aaaa bbbb", "  ", "...", "0o", "ĐƯỜNG"}
    for r in aliases:
        for _ in range(6):
            t = list(r["alias"])
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice("abcnot hi")
            texts.add("".join(t))
    boxes = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {(r["text"], r["field"], r["alias"]): r["similarity"] for r in A.label_scores(boxes, A.label_table(spark), method).collect()}
    keyed = boxes.where("trim(text) <> ''").select("text", X.key("text", "anchor").alias("x"), X.key("text", "compact").alias("u")).collect()

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a):
            row, old = [i + 1], row
            for j, d in enumerate(b):
                row.append(min(old[j] + (c != d), old[j + 1] + 1, row[j] + 1))
        return row[-1]

    ratio = (lambda a, b: SequenceMatcher(None, a, b).ratio()) if method == "gestalt" else (lambda a, b: 1 - distance(a, b) / max(len(a), len(b)))
    contained = lambda a, b: min(len(a), len(b)) / max(len(a), len(b)) if a in b or b in a else 0.0
    want = {}
    for t in keyed:
        for r in aliases:
            x, y, u, v = t["x"], r["alias_key"], t["u"], r["alias_compact"]
            if x and y:
                s = 1.0 if x == y or u == v else max(ratio(x, y), ratio(u, v), contained(x, y), contained(u, v))
                if s >= r["min_similarity"]:
                    want[t["text"], r["field"], r["alias"]] = s
    assert len(want) > 150 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


@pytest.mark.parametrize("few", [D.FEW_VALUES, 0])
def test_rules_once_per_value_equal_rules_per_row(spark, monkeypatch, few):
    monkeypatch.setattr(D, "FEW_VALUES", few)
    folder = "/root/testdata/sf0.001"
    cards = V.cards(spark, folder).where("doc_id < 400").withColumnRenamed("line_no", "at")
    bag = lambda df: sorted(map(str, df.collect()))
    once = L.renumber(L.normalized(cards, compose=False, once=True, facts=True))
    plain = L.renumber(L.normalized(cards, compose=False))
    assert bag(once.drop("facts")) == bag(plain)
    want = bag(L.extract_by_lines(plain))
    assert bag(L.extract_by_lines(once)) == want == bag(L.extract_by_lines(plain, once=True))
    readings = V.candidates(spark, folder).where("doc_id < 400")
    raw, value = F.col("source") == "RAW_TEXT_RECOVERY", F.lit(None).cast("string")
    for field, rule in Fu.RULES.items():
        value = F.when(F.col("field") == field, rule(F.col("value"))).otherwise(value)
    per_row = readings.withColumn("value", F.when(raw, F.col("value")).otherwise(value)).where("value <> ''")
    assert bag(Fu.clean_candidates(readings)) == bag(per_row)


def odd_boxes(spark):
    rng = random.Random(4)
    rows = []
    for doc in range(4):
        for k in range((40, 250, 1, 20)[doc]):
            top, left = rng.uniform(0, 400), rng.uniform(0, 600)
            tall, wide = rng.choice([0.0, 5.0, 12.0, 8.0, rng.uniform(50, 200)]), rng.choice([0.0, 30.0, rng.uniform(5, 300)])
            rows.append((doc, k, f"x{k}", left, top, left + wide, top + tall, rng.random()))
    return spark.createDataFrame(rows, BOX)


def test_cells_find_the_pairs_of_the_plain_join(spark, monkeypatch):
    boxes = odd_boxes(spark)
    hits = boxes.where("box_id % 5 = 0").selectExpr("*", "'f' AS field", "'a' AS alias", "0.7D AS similarity", "1 AS field_pos", "'right' AS preferred")
    points = spark.range(300).selectExpr("id % 4 AS doc_id", "id AS point_id", "double(id * 37 % 600) AS x", "double(id * 91 % 400) AS y")

    def pairs():
        found = [B.relate(boxes, "right_of"), B.relate(boxes, "below", strict=True), B.relate(boxes, "same_line"), B.contains_box(boxes, 9.0), B.contains_point(boxes, points)]
        found += [A._values(boxes, hits, "right", 3.0), A._values(boxes, hits, "below", 5.0)]
        return [sorted(map(str, df.collect())) for df in found]

    plain = pairs()
    monkeypatch.setattr(B, "MANY", 30)
    assert pairs() == plain and all(plain)


def test_card_boxes_are_dealt_once(spark):
    """Cards dealt by card were dealt once more when their boxes were written."""
    loose = Q_boxes.loose_card_boxes(spark, "/root/testdata/sf0.001")
    assert sorted(map(str, loose.collect())) == sorted(map(str, Q_boxes.card_boxes(spark, "/root/testdata/sf0.001").collect()))
    plan = loose._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("REPARTITION_BY_NUM") == 1


def test_one_crowded_document_is_no_square(spark):
    """60,000 boxes of one page: the pairs are those beside each other, found without meeting all others."""
    boxes = spark.range(60_000).selectExpr("1L AS doc_id", "id AS box_id", "'x' AS text", "double(id % 100 * 30) AS left", "double(id div 100) * 20 AS top", "double(id % 100 * 30 + 20) AS right", "double(id div 100) * 20 + 12 AS bottom", "0.9D AS confidence")
    hits = boxes.selectExpr("*", "'f' AS field", "'a' AS alias", "0.7D AS similarity")
    found = A._values(boxes, hits, "right", 1.0)  # a gap of 10, one of 40 would be the next but one
    assert found.count() == 60_000 - 600
    assert A._values(boxes, hits, "below", 1.0).count() == 60_000 - 100


def rows_of(boxes, mode):
    """Greedy grouping, all groups looked at for every box."""
    ratio = lambda n, d: n / d if d > 0 else 0.0
    groups, place, edge, island = [], {}, None, 0
    for b in sorted(boxes, key=lambda r: (r["top"], r["left"], r["box_id"])):
        if mode != "centre" and (edge is None or b["top"] >= edge):
            island += 1
        edge = b["bottom"] if edge is None else max(edge, b["bottom"])
        top, bottom, centre, tall = b["top"], b["bottom"], (b["top"] + b["bottom"]) / 2, max(b["bottom"] - b["top"], 1.0)
        best = None
        for g in (g for g in groups if g["island"] == island):
            both = max(min(bottom, g["bottom"]) - max(top, g["top"]), 0.0)
            if mode == "lines":
                own, away = g["bottom"] - g["top"], abs((g["top"] + g["bottom"]) / 2 - centre)
                fits = ratio(both, min(own, bottom - top)) >= 0.35 or ratio(away, (own + bottom - top) / 2) <= 0.8
            elif mode == "overlap":
                own, away = max(g["bottom"] - g["top"], 1.0), abs(centre - g["sum"] / g["n"])
                fits = both / max(min(tall, own), 1.0) >= 0.45 and abs(centre - (g["top"] + g["bottom"]) / 2) <= max(own, tall) * 0.25
            else:
                fits, away = abs(centre - g["sum"] / g["n"]) <= 0.6 * max(g["heights"] / g["n"], tall), 0.0
            if fits and (best is None or away < best[0]):
                best = away, g
        if best is None:
            best = 0, {"island": island, "top": top, "bottom": bottom, "sum": 0.0, "heights": 0.0, "n": 0, "id": len(groups) + 1}
            groups.append(best[1])
        g = best[1]
        g.update(top=min(g["top"], top), bottom=max(g["bottom"], bottom), sum=g["sum"] + centre, heights=g["heights"] + tall, n=g["n"] + 1)
        place[b["doc_id"], b["box_id"]] = g["id"]
    return place


@pytest.mark.parametrize("mode", ["lines", "overlap", "centre"])
def test_sweep_equals_the_plain_grouping(spark, monkeypatch, mode):
    monkeypatch.setattr(B, "CHUNK", 16)
    boxes = odd_boxes(spark)
    got = B.group_lines(boxes) if mode == "lines" else B.group_rows(boxes, mode=mode)
    by = {}
    for r in boxes.collect():
        by.setdefault(r["doc_id"], []).append(r)
    want = {k: v for rows in by.values() for k, v in rows_of(rows, mode).items()}
    assert {(r["doc_id"], r["box_id"]): r["line_id" if mode == "lines" else "row_id"] for r in got.collect()} == want


@pytest.mark.parametrize("group", [B.group_lines, B.group_rows])
def test_grouping_moves_boxes_once_and_joins_nothing(spark, group):
    """Boxes were made three times, grouped, and joined back by a second shuffle."""
    found = group(V.boxes(spark, "/root/testdata/sf0.001"))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Union" not in plan


@pytest.mark.parametrize("height", [0.0, 0.3, 0.6, 12.0])
@pytest.mark.parametrize("mode", ["lines", "overlap"])
def test_level_islands_equal_the_plain_grouping(spark, mode, height):
    """Boxes of equal edges: one group, or where they are too flat to overlap one each."""
    boxes = spark.range(60).selectExpr("id % 3 AS doc_id", "id AS box_id", "'x' AS text", "double(id * 7 % 50) AS left", "double(id div 20) * 30 AS top", "double(id * 7 % 50 + 5) AS right", f"double(id div 20) * 30 + {height}D AS bottom", "0.9D AS confidence")
    got = B.group_lines(boxes) if mode == "lines" else B.group_rows(boxes)
    by = {}
    for r in boxes.collect():
        by.setdefault(r["doc_id"], []).append(r)
    want = {k: v for rows in by.values() for k, v in rows_of(rows, mode).items()}
    assert {(r["doc_id"], r["box_id"]): r["line_id" if mode == "lines" else "row_id"] for r in got.collect()} == want


def test_one_long_island(spark):
    boxes = spark.range(20_000).selectExpr("1L AS doc_id", "id AS box_id", "'x' AS text", "double(id % 50 * 20) AS left", "double(id div 50) * 12 AS top", "double(id % 50 * 20 + 18) AS right", "double(id div 50) * 12 + 20 AS bottom", "0.9D AS confidence")
    assert B.group_rows(boxes).select("row_id").distinct().count() == 400


@pytest.mark.parametrize("few", [D.FEW_VALUES, 0])
def test_terms_of_a_table_equal_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(Q, "FEW_VALUES", few)
    rng = random.Random(7)
    docs = [(k, "\n".join("".join(rng.choice("abcé ") for _ in range(rng.choice([0, 3, 40, 300]))) for _ in range(4))) for k in range(25)] + [(90, None), (91, "")]
    terms = {docs[rng.randrange(25)][1].replace("\n", " ")[k : k + rng.randint(1, 9)] for k in range(300)} | {"", "zzzz", "a", "é", docs[0][1].split("\n")[0]}
    got = Q.term_table_hits(spark.createDataFrame(docs, "path long, text string"), spark.createDataFrame([(t,) for t in [*terms, None, "a"]], "term string"))
    want = {(k, n + 1, t, line) for k, text in docs if text is not None for n, line in enumerate(text.split("\n")) for t in terms if t and t in line}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 500
    assert Q.term_table_hits(spark.createDataFrame(docs, "path long, text string"), spark.createDataFrame([("",)], "term string")).count() == 0


@pytest.mark.parametrize("few", [D.FEW_VALUES, 0])
def test_terms_across_stretches_count_once(spark, monkeypatch, few):
    monkeypatch.setattr(Q, "FEW_VALUES", few)
    monkeypatch.setattr(Q, "STRETCH", 5)
    rng = random.Random(8)
    lines = ["".join(rng.choice("ab😀") for _ in range(k)) for k in range(40)]
    terms = {lines[-1][k : k + n] for k in range(12) for n in (1, 2, 3, 4, 9, 20)}
    got = Q.term_table_hits(spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "path long, text string"), spark.createDataFrame([(t,) for t in terms], "term string"))
    assert sorted((r["path"], r["term"]) for r in got.collect()) == sorted((k, t) for k, line in enumerate(lines) for t in terms if t in line)


def test_terms_are_walked_not_compared(spark):
    """Each line was compared with every term whose piece it has, so a hit cost many terms once they were many."""
    docs = spark.createDataFrame([(k, f"abcd{k}\nxabcd{k % 7}") for k in range(50)], "path long, text string")
    got = Q.term_table_hits(docs, spark.createDataFrame([(f"abcd{k}",) for k in range(60)] + [("bc\nx",)], "term string"))
    assert "contains(" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    want = {(k, n, f"abcd{t}") for k in range(50) for n, line in ((1, f"abcd{k}"), (2, f"xabcd{k % 7}")) for t in range(60) if f"abcd{t}" in line}
    assert sorted(got.select("path", "line_no", "term").collect()) == sorted(want)


@pytest.mark.parametrize("window", [1, 3, 17, trie.WINDOW])
@pytest.mark.parametrize("letters", ["ab", "abcé ", "aé😀"])
def test_trie_finds_each_term_once_a_line(monkeypatch, window, letters):
    monkeypatch.setattr(trie, "WINDOW", window)
    rng = random.Random(window)
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    for terms in ({word(rng.randint(1, 7)) for _ in range(60)} | {"zz"}, {word(1)}, set()):
        terms, lines = sorted(terms), [word(rng.choice([0, 1, 2, 5, 40])) for _ in range(30)]
        grown = trie.grown(*trie.packed(pa.chunked_array([pa.array([t.encode() for t in terms], pa.binary())])))
        data, starts, sizes = trie.packed(pa.array([f"{x}\n".encode() for x in lines]))
        got = [(first + i, terms[t]) for first, counts, found in trie.held(grown, data, starts + sizes) for i, t in zip(np.repeat(np.arange(len(counts)), counts), found)]
        assert sorted(got) == sorted((i, t) for i, x in enumerate(lines) for t in terms if t in x)


def test_lines_of_one_file_are_dealt_to_all_tasks_before_they_meet_terms(spark):
    """A file of one row group was one task; what stands for a line was made once a hit."""
    docs = spark.createDataFrame([(k, "\n".join(f"some line {k} {n}" for n in range(9))) for k in range(200)], "path long, text string").coalesce(1)
    got = Q.term_table_hits(docs, spark.createDataFrame([("line",), ("some",)], "term string"), shown=F.md5)
    assert got.rdd.getNumPartitions() >= 4
    assert got.select(F.spark_partition_id()).distinct().count() >= 4
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("md5(")
    assert got.where("line = md5(concat('some line ', path, ' ', line_no - 1))").count() == 3600


def test_fused_records_need_no_shuffle(spark):
    """The cleaned and the fused readings lie in buckets of documents; what reads them moves nothing."""
    records = Fu.fuse_records(V.candidates(spark, "/root/testdata/sf0.001").where("doc_id < 300"))
    records.collect()
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" in plan


def test_cards_are_dealt_in_parts_that_grow_with_them(spark, monkeypatch):
    """A file of one row group was one task of all text rules."""
    sf = "/root/testdata/sf0.001"
    assert V.cards(spark, sf).rdd.getNumPartitions() >= 4
    monkeypatch.setattr(V, "CARDS_A_TASK", 100)
    assert V.cards(spark, sf).rdd.getNumPartitions() == -(-spark.read.parquet(f"{sf}/orders.parquet").count() // 100)


@pytest.mark.parametrize("few", [0, 2, 100])
def test_remembered_values_equal_those_worked_out_in_place(spark, monkeypatch, few):
    monkeypatch.setattr(D, "FEW_VALUES", few)
    texts = ["Ngaysinh/Date of birth: 01/02/1990", "No: 0010 9501 0001", "", None, " a ,b ", "ﬁve", "x" * 300]
    lines = spark.createDataFrame([(k, k % 3, texts[min(k % 9, 6)] if k < 60 else f"So / No: {k}") for k in range(80)], "doc_id long, at int, line string")
    once, plain = (L.normalized(lines, once=o, facts=True) for o in (True, False))
    assert sorted(map(str, once.collect())) == sorted(map(str, plain.collect()))
    assert "SortMergeJoin" not in once._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [D.FEW_VALUES, 1])
def test_facts_of_frequent_lines_are_worked_out_once(spark, monkeypatch, few):
    """The address rule ran on every line; now on the frequent ones of the dictionary, and in place on the others."""
    monkeypatch.setattr(D, "FEW_VALUES", few)
    sf = "/root/testdata/sf0.001"
    got = TQ.lines_of(spark, sf, X.is_valid_address("line", True))
    want = TQ.lines_of(spark, sf).withColumn("facts", X.is_valid_address("line", True))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and want.where("facts").count() > 10
    assert re.search(r"__known#\d+\.facts", got._jdf.queryExecution().analyzed().toString())


def test_label_hits_move_no_box_by_its_text(spark):
    """A label stands on most cards: its boxes were one key of a merge join."""
    boxes = spark.createDataFrame([(k, 0, "Ho va ten", 0.0, 0.0, 9.0, 9.0, 0.5) for k in range(50)] + [(1, 1, "123456789012", 0.0, 20.0, 9.0, 29.0, 0.5), (2, 1, "0 0", 0.0, 20.0, 9.0, 29.0, 0.5)], BOX)
    hits = A.label_hits(boxes, A.label_table(spark), "levenshtein")
    assert "SortMergeJoin" not in hits._jdf.queryExecution().executedPlan().toString()
    assert {r[0] for r in hits.select("doc_id").collect()} == set(range(50))


def test_misread_labels_move_no_line(spark):
    lines = spark.createDataFrame([(k, 0, "Duto of erpiry") for k in range(20)] + [(99, 0, "Nam")], "doc_id long, line_no int, line string")
    flagged = L.with_expiry_flag(lines)
    assert "SortMergeJoin" not in flagged._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"] for r in flagged.where("is_expiry").collect()} == set(range(20))


def test_legacy_extraction_reads_its_lines_once(spark):
    lines = spark.createDataFrame([(1, 0, "HO VA TEN"), (1, 1, "TRAN MAU"), (2, 0, "LE LAN")], "doc_id long, line_no int, line string")
    got = L.extract_by_lines(lines, legacy=True)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["doc_id"], r["fullName"]) for r in got.collect()) == [(1, "TRAN MAU"), (2, "LE LAN")]


def test_template_values_equal_those_cleaned_one_by_one(spark, monkeypatch):
    boxes = spark.createDataFrame([(k, 1, ("Nam", "Nu", f"x {k}")[k % 3], 420.0, 260.0, 440.0, 270.0, 0.5) for k in range(30)], BOX)
    pages = boxes.select("doc_id", F.lit(1000).alias("page_width"), F.lit(630).alias("page_height"))
    made = [sorted(map(str, B.template_fields(boxes, pages).collect()))]
    monkeypatch.setattr(D, "FEW_VALUES", 1)
    made.append(sorted(map(str, B.template_fields(boxes, pages).collect())))
    plain = B.template_fields(boxes, pages)
    assert made[0] == made[1] and len(made[0]) >= 30
    assert plain.where(~F.col("value").eqNullSafe(B.clean_field("field", "raw"))).count() == 0


def test_pairs_within_a_gap_need_no_join(spark):
    """Each box was shuffled to its strips twice, once for each side of a join."""
    rng = random.Random(5)
    rows = [(k % 2, k, "x", left, 0.0, left + rng.choice([0.0, 5.0, 900.0]), 9.0, 0.5) for k in range(120) for left in [rng.uniform(-900, 3000)]]
    boxes = spark.createDataFrame(rows, BOX)
    pairs = B.pair_metrics(boxes, within=150.0)
    assert "Join" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    near = lambda a, b: max(b[3] - a[5], a[3] - b[5], 0.0) <= 150.0
    want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and near(a, b))
    assert sorted((r["doc_id"], r["a"], r["b"]) for r in pairs.collect()) == want


def test_records_of_arrivals_move_lines_once_and_before_their_facts(spark):
    from pergament.streaming.records import records_of

    arrivals = spark.createDataFrame([(k, ["No: 001095010001", "", "Gioi tinh / Sex: Nam"]) for k in range(20)], "doc_id long, lines array<string>")
    made = records_of(arrivals)
    plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1
    assert {(r["idNumber"], r["gender"]) for r in made.collect()} == {("001095010001", "Nam")} and made.count() == 20


@pytest.mark.parametrize("compare_text", [True, False])
def test_only_boxes_of_larger_parts_are_grouped(spark, monkeypatch, compare_text):
    """Lone boxes and pairs are judged beside each other; the rest is folded. Both as one greedy pass over all boxes."""
    rng, rows = random.Random(11), []
    for doc in range(40):
        for part in range(12):
            left, top, n = 100.0 * part, 30.0 * rng.randint(0, 3), rng.choice([1, 1, 2, 2, 2, 3, 5])
            for _ in range(n):
                x, wide = left + rng.choice([0, 0, 1, 2, 30]), rng.choice([40, 40, 41, 20, 0])
                rows.append((doc, len(rows) if rng.random() < 0.9 else 7, rng.choice(["a", "A.", "b", "", None]), x, top, x + wide, top + rng.choice([20, 20, 19]), rng.choice([0.2, 0.5, 0.5, 0.9])))
    handed = []

    def folded(df, *more):
        handed.append(df.count())
        return plain(df, *more)

    plain = B._folded
    monkeypatch.setattr(B, "_folded", folded)
    got = sorted(map(tuple, B.suppress_duplicates(spark.createDataFrame(rows, BOX), 0.8, compare_text).collect()), key=repr)
    key = lambda t: None if t is None else re.sub(r"[\W_]", "", t.lower()) if compare_text else ""
    keyed = lambda r: key(r[2]) if compare_text else ""
    area = lambda r: (r[5] - r[3]) * (r[6] - r[4])

    def iou(a, b):
        both = max(min(a[5], b[5]) - max(a[3], b[3]), 0) * max(min(a[6], b[6]) - max(a[4], b[4]), 0)
        return both / (area(a) + area(b) - both) if area(a) + area(b) - both > 0 else 0.0

    want = []
    for r in sorted(rows, key=lambda r: (r[0], -r[7], -area(r), r[1], r[2] is not None, r[2] or "", *r[3:])):
        if not any(k[0] == r[0] and keyed(k) == keyed(r) and iou(k, r) >= 0.8 for k in want):
            want.append(r)
    assert got == sorted(want, key=repr)
    assert 0 < handed[0] < len(rows) / 2


@pytest.mark.parametrize("few", [D.FEW_VALUES, 1])
def test_layout_rules_run_once_for_frequent_texts(spark, monkeypatch, few):
    """Every box went through the identifier and date rules, every chosen value through its field's."""
    sf = "/root/testdata/sf0.001"
    cards = Q_boxes.card_boxes(spark, sf).where("doc_id < 400")
    monkeypatch.setattr(D, "FEW_VALUES", few)
    got = A.extract_by_layout(cards, method="levenshtein")
    assert re.search(r"__known#\d+\.idNumber", got._jdf.queryExecution().analyzed().toString())
    long, rows = A.extract_by_layout(cards, method="levenshtein", debug=True), {r["doc_id"]: r for r in got.collect()}
    told = long.select("doc_id", "field", "value_text", "value", *(rule(F.col("value_text")).alias(f"by_{f}") for f, rule in A.LAYOUT_RULES.items())).collect()
    assert len(told) > 1000 and all(r["value"] == r[f"by_{r['field']}"] for r in told)
    backed = {kind: {r["doc_id"]: r["value"] for r in made.collect()} for kind, made in (("idNumber", A.id_fallback(B.prepare_boxes(cards))), ("dateOfBirth", A.date_fallback(B.prepare_boxes(cards))))}
    own = {(r["doc_id"], r["field"]): r["value"] for r in told}
    assert all(rows[d][f] == ((own.get((d, f)) or None if f == "idNumber" else own.get((d, f))) or found.get(d) or "") for f, found in backed.items() for d in rows)


@pytest.mark.parametrize("few", [D.FEW_VALUES, 0])
def test_equal_sets_of_readings_are_fused_once(spark, monkeypatch, few):
    """Names and places were put together for every document; now once for each distinct set of readings."""
    monkeypatch.setattr(D, "FEW_VALUES", few)
    seen, named = [], Fu.named
    monkeypatch.setattr(Fu, "named", lambda readings: seen.append(readings.count()) or named(readings))
    kinds = [
        [("fullName", "FIELD_OCR", "HO VAN MAU"), ("fullName", "FULL_CARD_OCR", "HỒ VĂN MAU"), ("gender", "FIELD_OCR", "Nam"), ("placeOfOrigin", "FULL_CARD_OCR", "Xa Le Loi, Thai Binh"), ("placeOfOrigin", "FIELD_OCR", "Xa Lê Lợi, Thai Binh")],
        [("fullName", "FIELD_OCR", "TRAN THI LAN"), ("placeOfResidence", "RAW_TEXT_RECOVERY", "Xa Vu Thu, Nam Dinh, To 18"), ("placeOfResidence", "FULL_CARD_OCR", "Xa Vu Thu, Nam Dinh, To B8")],
        [("gender", "FIELD_OCR", "Nu")],
    ]
    table = lambda docs: spark.createDataFrame([(d, *r) for d in docs for r in kinds[d % 3]], "doc_id long, field string, source string, value string")
    told = lambda rows: {tuple(r)[1:] for r in rows.withColumn("sources", F.to_json("sources")).collect()}
    all_ = Fu.fuse_records(table(range(60)))
    assert all_.count() == 60 and seen == [2 + 1]
    assert told(all_) == set().union(*(told(Fu.fuse_records(table([d]))) for d in range(3))) and len(told(all_)) == 3
    origin = {r["placeOfOrigin"] for r in all_.collect()}
    assert any(o and "Lê Lợi" in o for o in origin) and None in origin


def test_pieces_of_frequent_lines_are_known_once_in_recovered_addresses(spark, monkeypatch):
    """Every line had its expiry mark, every label line its pieces and every block its address worked out anew; the lines ahead were listed for each line."""
    lines = D.stored(TQ.lines_of(spark, "/root/testdata/sf0.001").where("doc_id < 500"), "lines")
    for field in ("placeOfOrigin", "placeOfResidence"):
        made = []
        for few in (D.FEW_VALUES, 1):
            with monkeypatch.context() as m:
                m.setattr(D, "FEW_VALUES", few)
                got = L.address_block(lines, field, mode="recover")
                assert "__known.valid" in re.sub(r"#\d+", "", got._jdf.queryExecution().analyzed().toString())
                made.append(sorted(map(str, got.collect())))
        assert made[0] == made[1] and sum("None" not in r for r in made[0]) > 100
    flagged = L.with_expiry_flag(lines)._jdf.queryExecution().analyzed().toString()
    assert "__known.cand" in re.sub(r"#\d+", "", flagged)
