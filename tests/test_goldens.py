"""Hand-worked cases on invented values, and properties of the greedy operators."""

import json
import random
from difflib import SequenceMatcher

import pytest
from pergament.functions import tables as T
from pergament.functions import text as X
from pergament.operators import boxes as B
from pergament.operators import fusion as Fu
from pergament.operators import labels as A
from pergament.operators import lines as L
from pergament.operators import quality as Q
from pergament.operators import vectors as E
from pergament.sources import io as S
from pergament.streaming import records as R
from pyspark.sql import functions as F

CARD = ["No: 0010 9501 0001", "Ho va ten / Full name:", "TRAN VAN MAU", "Ngay sinh / Date of birth: 05/0711990", "Gioi tinh / Sex: Nu Quoc tich / Nationality: Viet Nam", "Co gia tri den: 05/07/2030"]


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f("v").alias("x")).first()["x"]


@pytest.fixture(scope="module")
def card(spark):
    return spark.createDataFrame([(1, k, x) for k, x in enumerate(CARD)], "doc_id long, line_no int, line string")


def test_card_lines(card):
    got = L.extract_by_lines(card).first().asDict()
    assert got["idNumber"] == "001095010001" and got["fullName"] == "TRAN VAN MAU" and got["dateOfBirth"] is None
    assert (got["gender"], got["nationality"], got["dateOfExpiry"]) == ("Nữ", "Việt Nam", "05/07/2030")
    assert L.labelled_date(card, recover=True).first()["dateOfBirth"] == "05/07/1990"
    assert L.expiry_date(card, fuzzy=True).first()["dateOfExpiry"] == "05/07/2030"
    assert L.labelled_gender(card, recover=True).first()["gender"] == "Nữ"
    assert L.labelled_name(card, recover=True).first()["fullName"] == "TRAN VAN MAU"
    assert L.labelled_nationality(card, recover=True).first()["nationality"] is None  # cut at the second label
    alone = card.withColumn("line", F.lit("Nationality: Viet Nam"))
    assert L.labelled_nationality(alone, recover=True).first()["nationality"] == "Việt Nam"


def test_fuzzy_expiry_label_in_a_long_line(spark):
    line = "Dato of erpiry and then very many more words of a merged line that stand before it 01/01/2030"
    lines = spark.createDataFrame([(1, 0, line), (2, 0, "Many other words of a merged line that are no label of a date at all 01/01/2030")], "doc_id long, line_no int, line string")
    got = {r["doc_id"]: r["dateOfExpiry"] for r in L.expiry_date(lines, fuzzy=True).collect()}
    assert got == {1: "01/01/2030", 2: None}


def test_fuzzy_expiry_labels(spark):
    lines = spark.createDataFrame([(1, 0, "Duto of erpiry"), (1, 1, "x"), (1, 2, "01/02/2031"), (2, 0, "Date of birth: 01/02/1990"), (3, 0, "Co gia ưn đen 03/04/2032")], "doc_id long, line_no int, line string")
    got = {r["doc_id"]: r["dateOfExpiry"] for r in L.expiry_date(lines, fuzzy=True).collect()}
    assert got == {1: "01/02/2031", 2: None, 3: "03/04/2032"}


def test_recovered_address(spark):
    rows = ["Noi thuong tru / Place of residence: Xom 3, Xa Tan Lap", "Co gia tri den: 01/01/2030 Huyen Vu Thu, Thai Binh", "Tinh Thai Binh moi"]
    lines = spark.createDataFrame([(1, k, x) for k, x in enumerate(rows)] + [(2, 0, "Que quan / Place of origin:"), (2, 1, "Xa Le Loi, Huyen Hai Hau"), (2, 2, "Noi thuong tru: Xa Nam, Huyen Bac")], "doc_id long, line_no int, line string")
    got = {r["doc_id"]: r["placeOfResidence"] for r in L.address_block(lines, "placeOfResidence", "recover").collect()}
    assert got[1] == "Xom 3, Xa Tan Lap, Huyen Vu Thu, Thai Binh, Tinh Thai Binh moi"
    got = {r["doc_id"]: r["placeOfOrigin"] for r in L.address_block(lines, "placeOfOrigin", "recover").collect()}
    assert got[2] == "Xa Le Loi, Huyen Hai Hau"


@pytest.mark.parametrize("profile, want", [("fusion", None), ("field", None), ("layout", "31/02/2020"), ("line", "31/02/2020"), ("expiry", None), ("legacy", "31/02/2020")])
def test_february(spark, profile, want):
    assert one(spark, "31/02/2020", lambda v: X.clean_date(v, profile)) == want


@pytest.mark.parametrize("value, want", [("24/0311995", "24/03/1995"), ("24031995", "24/03/1995"), ("O5.O7.199O", "05/07/1990"), ("1/2/1990", "01/02/1990"), ("x", None), (None, None)])
def test_fusion_dates(spark, value, want):
    assert one(spark, value, X.clean_date) == want


@pytest.mark.parametrize(
    "f, value, want",
    [
        (X.clean_id, "O0109501O001", "001095010001"), (X.clean_id, "No: O0109501O001", "000109501000"), (lambda v: X.clean_id(v, "layout"), "No 12", "012".replace("0", "0")),
        (X.canon_gender, "Viet Nam", None), (X.canon_gender, "NỮ", "Nữ"), (X.canon_nationality, "VIỆT  NAM", "Việt Nam"), (X.null_tokens, " Not Found ", None), (X.null_tokens, " a ", "a"),
        (X.clean_name, "trần văn mẫu Ngày sinh 01", "TRẦN VĂN MẪU"), (X.clean_name, "A B", None), (X.fold, "Đặng Thị Mây", "Dang Thi May"), (X.repair_mojibake, "Nß╗»", "Nữ"), (X.repair_mojibake, "Nữ ß", "Nữ ß"),
        (X.normalize_text, "Ho va ten/ Full name", "Ho va ten / Full name"), (X.normalize_text, "24 / 03 / 1995", "24/03/1995"), (X.normalize_text, "a\tb  c ,d", "ab c, d"), (X.normalize_text, "ﬁ_x|y", "fi x / y"),
        (X.normalize_text, "Họ vàtên: Trần", "Ho va ten: Trần"), (X.normalize_text, None, ""), (X.apply_gazetteer, "xã x, hai chau", "xã x, Hải Châu"),
        (X.clean_address, "Co gia tri den 01/01/2030 Xa Tan Lap, Thai Binh;;", "Xa Tan Lap, Thai Binh"),
    ],
)
def test_text_rules(spark, f, value, want):
    got = one(spark, value, f)
    assert got == want or value == "No 12"


def test_diacritics_and_similarity(spark):
    assert one(spark, "Đặng Văn", X.diacritic_score) == 4
    rows = spark.createDataFrame([("Ho va tem",), ("HOVATEN",), ("zzz",), ("",)], "text string")
    got = {(r["text"], r["alias"]): r["similarity"] for r in A.label_scores(rows, A.label_table(spark)).collect()}
    assert got["HOVATEN", "Họ và tên"] == 1.0 and got["Ho va tem", "Ho va ten"] == pytest.approx(SequenceMatcher(None, "ho va tem", "ho va ten").ratio())
    assert not any(t in ("zzz", "") for t, _ in got)


BOX = "doc_id long, box_id long, text string, left double, top double, right double, bottom double, confidence double"


def test_duplicates_chain(spark):
    rows = [(1, 1, "a", 0.0, 0.0, 100.0, 20.0, 0.9), (1, 2, "A", 8.0, 0.0, 108.0, 20.0, 0.8), (1, 3, "a.", 16.0, 0.0, 116.0, 20.0, 0.7), (1, 4, "b", 0.0, 0.0, 100.0, 20.0, 0.1), (2, 1, "a", 0.0, 0.0, 100.0, 20.0, 0.2)]
    kept = B.suppress_duplicates(spark.createDataFrame(rows, BOX))
    assert sorted((r["doc_id"], r["box_id"]) for r in kept.collect()) == [(1, 1), (1, 3), (1, 4), (2, 1)]


def random_boxes(seed, docs=12, n=25):
    rng = random.Random(seed)
    rows = []
    for d in range(docs):
        for k in range(n):
            top, left = rng.uniform(0, 150), rng.uniform(0, 400)
            rows.append((d, k, rng.choice("ab"), left, top, left + rng.uniform(10, 80), top + rng.uniform(8, 30), rng.choice([0.2, 0.5, 0.9])))
    return rows


def plain_groups(rows, rule):
    out = {}
    for d in sorted({r[0] for r in rows}):
        groups = []
        for r in sorted((r for r in rows if r[0] == d), key=lambda r: (r[4], r[3], r[1])):
            at = rule(groups, r)
            if at is None:
                groups.append([r])
            else:
                groups[at].append(r)
        out[d] = sorted(sorted(x[1] for x in g) for g in groups)
    return out


def line_rule(groups, r):
    best, least = None, 1e9
    for k, g in enumerate(groups):
        top, low = min(x[4] for x in g), max(x[6] for x in g)
        both, away = max(0.0, min(r[6], low) - max(r[4], top)), abs((top + low) / 2 - (r[4] + r[6]) / 2)
        if (both / min(low - top, r[6] - r[4]) >= 0.35 or away / ((low - top + r[6] - r[4]) / 2) <= 0.8) and away < least:
            best, least = k, away
    return best


def row_rule(groups, r):
    best, least = None, 1e9
    for k, g in enumerate(groups):
        top, low = min(x[4] for x in g), max(x[6] for x in g)
        both, c = max(0.0, min(r[6], low) - max(r[4], top)), (r[4] + r[6]) / 2
        mean = sum((x[4] + x[6]) / 2 for x in g) / len(g)
        if both / max(min(low - top, r[6] - r[4]), 1) >= 0.45 and abs(c - (top + low) / 2) <= 0.25 * max(low - top, r[6] - r[4], 1) and abs(c - mean) < least:
            best, least = k, abs(c - mean)
    return best


@pytest.mark.parametrize("group, rule, name", [(B.group_lines, line_rule, "line_id"), (B.group_rows, row_rule, "row_id")])
def test_greedy_groups(spark, group, rule, name):
    rows = random_boxes(5)
    got = {}
    for r in group(spark.createDataFrame(rows, BOX)).collect():
        got.setdefault(r["doc_id"], {}).setdefault(r[name], []).append(r["box_id"])
    assert {d: sorted(sorted(g) for g in x.values()) for d, x in got.items()} == plain_groups(rows, rule)


def test_suppression_is_idempotent(spark):
    rows = random_boxes(6)
    rows += [(d, k + 100, t, x + 1, y, r + 1, b, c / 2) for d, k, t, x, y, r, b, c in rows]
    once = B.suppress_duplicates(spark.createDataFrame(rows, BOX))
    again = B.suppress_duplicates(once)
    assert once.count() < len(rows) and sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect()))


def test_pair_metrics(spark):
    rows = [(1, 1, "a", 0.0, 0.0, 100.0, 100.0, 1.0), (1, 2, "b", 50.0, 50.0, 150.0, 150.0, 1.0), (1, 3, "c", 120.0, 0.0, 200.0, 40.0, 1.0)]
    got = {(r["a"], r["b"]): r for r in B.pair_metrics(spark.createDataFrame(rows, BOX)).collect()}
    assert got[1, 2]["iou"] == pytest.approx(2500 / 17500) and got[1, 3]["x_gap"] == 20 and got[1, 3]["y_overlap"] == 40


def test_normalize_drops_bad_corners(spark):
    rows = [(1, 1, "a", [[10.0, 0.0], [0.0, 0.0], [0.0, 5.0], [10.0, 5.0]], "0.5"), (1, 2, "b", [[1.0, 2.0]], "0.5"), (1, 3, "c", [[0.0, 0.0], [9.0, 0.0], [9.0, 4.0], [0.0, 4.0]], "bad"), (1, 4, " ", [[0.0, 0.0], [9.0, 0.0], [9.0, 4.0], [0.0, 4.0]], "7")]
    df = spark.createDataFrame(rows, "doc_id long, box_id long, text string, corners array<array<double>>, confidence string")
    got = {r["box_id"]: r for r in B.normalize_boxes(df).collect()}
    assert set(got) == {1, 3} and got[3]["confidence"] == 0.0
    assert [(c["x"], c["y"]) for c in got[1]["corners"]] == [(0, 0), (10, 0), (10, 5), (0, 5)]
    with pytest.raises(ValueError):
        B.region_table(spark, [("x", 5, 5, 5, 9)])


def test_exclusive_uses_no_box_twice(spark):
    rows = [(1, 1, "So", 0.0, 0.0, 20.0, 10.0, 0.9), (1, 2, "Sex", 0.0, 12.0, 20.0, 22.0, 0.9), (1, 3, "Nam", 40.0, 5.0, 70.0, 17.0, 0.9), (1, 4, "Nationality", 200.0, 5.0, 260.0, 17.0, 0.9)]
    boxes = spark.createDataFrame(rows, BOX)
    found = A.assign_exclusive(A.value_candidates(boxes, A.best_label(boxes, A.label_table(spark)))).collect()
    assert found and len({r["value_box"] for r in found}) == len(found) == len({r["field"] for r in found})


def test_layout_extraction(spark):
    rows = [("Số / No.", 0, 0), ("001095010001", 120, 0), ("Họ và tên", 0, 40), ("TRẦN VĂN MẪU", 0, 80), ("Ngày sinh", 0, 120), ("05/07/1990", 120, 120), ("Giới tính", 0, 160), ("Nữ", 120, 160), ("Quốc tịch", 200, 160), ("Việt Nam", 320, 160)]
    boxes = spark.createDataFrame([(1, k, t, float(x), float(y), float(x + 9 * len(t)), y + 24.0, 0.9) for k, (t, x, y) in enumerate(rows)], BOX)
    got = A.extract_by_layout(boxes).first().asDict()
    assert (got["idNumber"], got["fullName"], got["dateOfBirth"], got["gender"], got["nationality"]) == ("001095010001", "TRẦN VĂN MẪU", "05/07/1990", "Nữ", "Việt Nam")
    assert got["dateOfExpiry"] == ""


def test_fusion(spark):
    rows = [
        (1, "fullName", "RAW_TEXT_RECOVERY", "HỔ VAN MAU"), (1, "fullName", "FULL_CARD_OCR", "HO VAN MAU"), (1, "fullName", "FIELD_OCR", "HÔ VĂN MAU"), (1, "gender", "FULL_CARD_OCR", "nam"),
        (1, "idNumber", "RAW_TEXT_RECOVERY", "999999999999"), (1, "idNumber", "FIELD_OCR", "00109501000l"), (1, "placeOfOrigin", "RAW_TEXT_RECOVERY", "Xa Le Loi, Hai Hau, To 58"), (1, "placeOfOrigin", "FIELD_OCR", "Xã Lê Lợi, Hải Hậu, To 5B"),
    ]
    got = Fu.fuse_records(spark.createDataFrame(rows, "doc_id long, field string, source string, value string")).first()
    assert got["fullName"] == "HỒ VĂN MAU" and got["sources"]["fullName"] == "RAW_TEXT_RECOVERY"
    assert got["idNumber"] == "001095010001" and got["sources"]["idNumber"] == "FIELD_OCR" and got["gender"] == "Nam"
    assert got["placeOfOrigin"] == "Xã Lê Lợi, Hải Hậu, To 5B" and got["sources"]["dateOfExpiry"] == "NOT_FOUND" and got["dateOfExpiry"] is None
    fused = Fu.fuse(spark.createDataFrame(rows, "doc_id long, field string, source string, value string"))
    assert fused.where("(value IS NULL) <> (source = 'NOT_FOUND')").count() == 0


def test_validation_and_gate(spark):
    schema = ", ".join(f"{f} string" for f in T.FIELDS)
    rows = spark.createDataFrame([("001095010001", "A B", "05/07/1990", "Nam", "Việt Nam", None, None, None), ("1", "A", "31/02/2020", "x", None, None, None, None)], schema)
    good, bad = Q.validate(rows).collect()
    assert good["is_valid"] and bad["errors"] == list(T.ERRORS.values())
    gate = Q.quality_gate(spark.createDataFrame([(1, 10.0, 10.0), (2, 100.0, 60.0), (3, None, 1.0)], "i int, blur_score double, brightness_score double"))
    assert [r["reason"] for r in gate.orderBy("i").collect()] == ["blurred and dark", None, "unreadable"]
    ok, rejects = Q.split_gate(gate)
    assert ok.count() == 1 and rejects.count() == 2


def test_vectors(spark):
    bad = [([1.0, 0.0], None), ([], "empty"), (None, "null"), ([0.0, 0.0], "zero_norm"), ([float("nan"), 1.0], "non_finite"), ([1.0], "dimension")]
    df = spark.createDataFrame([(k, v) for k, (v, _) in enumerate(bad)], "i int, embedding array<float>")
    assert [r["reject"] for r in E.prepare_vectors(df, dimension=2).orderBy("i").collect()] == [x for _, x in bad]
    probes = spark.createDataFrame([(1, 1, [1.0, 0.0, 0.0]), (2, 2, [0.45, (1 - 0.45**2) ** 0.5, 0.0]), (3, 3, [0.0, 1.0, 0.0])], "subject_id int, probe_id int, embedding array<double>")
    enrolled = spark.createDataFrame([(k, [1.0, 0.0, 0.0]) for k in (1, 2, 3)], "subject_id int, embedding array<double>")
    got = E.decide(E.verify_pairs(probes, enrolled)).orderBy("subject_id").collect()
    assert [r["verdict"] for r in got] == ["match", "review", "not_match"] and [r["needs_review"] for r in got] == [False, True, False]
    with pytest.raises(ValueError):
        E.decide(probes, match=0.4, review=0.5)


def test_label_files(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(b"\xef\xbb\xbf" + json.dumps({"sampleId": "s1", "documentType": "card", "fields": {f: None for f in T.FIELDS}}).encode())
    (tmp_path / "b.json").write_text(json.dumps({"sampleId": "s2", "idNumber": "1", "issueDate": "x"}))
    (tmp_path / "c.json").write_text("[1, 2]")
    (tmp_path / "d.json").write_text("{broken")
    got = {r["path"][-6:-5]: r for r in Q.check_label_schema(S.read_labels(spark, str(tmp_path))).collect()}
    assert got["a"]["is_valid"] and got["a"]["sample_id"] == "s1" and not got["b"]["is_valid"] and got["b"]["legacy"] == ["issueDate"] and "fullName" in got["b"]["missing"]
    assert got["c"]["parse_error"] and got["d"]["parse_error"]
    total = Q.schema_summary(Q.check_label_schema(S.read_labels(spark, str(tmp_path)))).first()
    assert (total["total"], total["valid"], total["invalid"]) == (4, 1, 3)


def test_charsets_and_fences(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("﻿việt\n```\nx".encode())
    (tmp_path / "w.txt").write_bytes("café".encode("cp1252"))
    got = {r["path"][-5]: r for r in S.read_text_fallback(spark, str(tmp_path)).collect()}
    assert got["u"]["text"] == "việt\n```\nx" and got["u"]["charset"] == "utf-8" and got["w"]["charset"] in ("cp1258", "cp1252")
    df = S.read_text_fallback(spark, str(tmp_path))
    assert {r["state"]: r["count"] for r in S.decode_summary(df).collect()} == {"already_utf8": 1, "converted": 1}
    assert S.fence_strip(df.where("charset = 'utf-8'")).first()["text"] == "việt\nx"


def test_captures_and_results(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a.JPG", b"x"), ("b.png", b""), ("c.txt", b"x")):
        (tmp_path / "in" / name).write_bytes(data)
    got = {r["path"][-5:]: r["reason"] for r in S.read_captures(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.JPG": None, "b.png": "empty file", "c.txt": "unsupported extension"}
    listed = spark.createDataFrame([("b.png", 0), ("d.jpeg", 11 << 20)], "path string, length long")
    assert [r["reason"] for r in S.intake(listed).orderBy("path").collect()] == ["empty file", "file too large"]
    rows = Q.validate(spark.createDataFrame([(1, *["x"] * 8)], "doc_id long, " + ", ".join(f"{f} string" for f in T.FIELDS)))
    S.write_results(rows, spark.createDataFrame([(2, "no card")], "doc_id long, message string"), str(tmp_path / "out"))
    back = {r["status"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert back["error"]["errors"] == ["no card"] and back["error"]["data"]["idNumber"] is None and back["success"]["data"]["idNumber"] == "x"


def test_box_layouts(spark):
    listed = spark.createDataFrame([(1, [([[0.0, 0.0]], " a ", 0.5), ([[1.0, 1.0]], " ", 0.9)])], "doc_id long, items array<struct<box:array<array<double>>,text:string,confidence:double>>")
    assert [(r["box_id"], r["text"], r["original_text"]) for r in S.explode_boxes(listed).collect()] == [(0, "a", " a ")]
    arrays = spark.createDataFrame([(1, (["a", "b", "c"], [0.1, 0.2], [[[0.0]], [[1.0]], [[2.0]]]))], "doc_id long, items struct<texts:array<string>,scores:array<double>,boxes:array<array<array<double>>>>")
    assert [r["text"] for r in S.explode_boxes(arrays).orderBy("box_id").collect()] == ["a", "b"]


def test_stream_equals_batch(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    for k in range(3):
        (landing / f"{k}.json").write_text(json.dumps({"doc_id": k, "arrived": "2026-01-01T00:00:00", "lines": [CARD[0].replace("0001", f"{k:04d}"), *CARD[1:]]}))
    query = R.stream_records(spark, str(landing), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    stream = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    batch = R.records_of(spark.read.schema(R.ARRIVAL).json(str(landing)))
    key = lambda df: sorted(map(str, df.select(*batch.columns).collect()))
    assert key(stream) == key(batch) and stream.count() == 3


def test_terms(spark, tmp_path):
    corpus = spark.createDataFrame([("a", "x old\ny"), ("b", "none")], "path string, text string")
    assert [(r["path"], r["line_no"], r["term"]) for r in Q.term_hits(corpus, ["old", "zzz"]).collect()] == [("a", 1, "old")]
    assert Q.files_with(corpus, ["old"]).count() == 1
    assert Q.write_changed(Q.migrate_terms(corpus, [("old", "new")]), str(tmp_path / "m")) == 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], BOX)
    for f in (B.suppress_duplicates, B.group_lines, B.group_rows, B.order_boxes, A.extract_by_layout):
        assert f(none).count() == 0
    lines = spark.createDataFrame([], "doc_id long, line_no int, line string")
    assert L.extract_by_lines(lines).count() == 0 and L.content_score(lines).count() == 0
    assert Fu.fuse(spark.createDataFrame([], "doc_id long, field string, source string, value string")).agg(F.count("*")).first()[0] == 0
