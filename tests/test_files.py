"""File listings, packed and ranged reading, and documents that arrive in parts."""

import json
from datetime import datetime, timedelta

import pytest
from pergament.sources import files as Fi
from pergament.sources import io as S
from pergament.streaming import parts as P
from pergament.streaming import records as R


def test_listing_holds_empty_files_and_all_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Fi, "FOLDERS", 3)
    sizes = {"a.jpg": 3, "b.jpg": 0, "x/c.PNG": 1, "x/y/d.gif": 2, "x/y/z/e.jpg": 0, "w/v/f.jpg": 5, "w/u/g.jpg": 1}
    for name, n in sizes.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"q" * n)
    got = {r["path"].removeprefix(f"{tmp_path}/"): r["length"] for r in Fi.list_files(spark, str(tmp_path)).collect()}
    assert got == sizes
    reasons = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in S.read_captures(spark, f"file:{tmp_path}").collect()}
    assert reasons["b.jpg"] == reasons["e.jpg"] == "empty file" and reasons["d.gif"] == "unsupported extension" and reasons["c.PNG"] is None


def test_small_files_share_tasks(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"{k}.json").write_text("﻿" * (k % 2) + json.dumps({"sampleId": str(k), "fields": {"idNumber": str(k)}}) if k else "", encoding="utf-8")
    found = S.read_labels(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 1
    rows = {r["path"].rsplit("/", 1)[1]: (r["sample_id"], r["parse_error"]) for r in found.collect()}
    assert rows["0.json"] == (None, "not a JSON object") and rows["7.json"] == ("7", None) and len(rows) == 300


@pytest.mark.parametrize("size", [1, 5, 16, 1000])
@pytest.mark.parametrize("text", [b"", b"\n", b"one", b"a\nbb\n\nccc\r\nlast", b"\n\nx\n", b"x" * 40 + b"\n" + b"y" * 3])
def test_lines_by_ranges(tmp_path, size, text):
    path = tmp_path / "t.txt"
    path.write_bytes(text)
    got = []
    for start in range(0, len(text), size):
        with open(path, "rb") as stream:
            for batch in Fi.lines_between(stream, "t", start, min(start + size, len(text)), piece=3):
                got += zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
    want, at = [], 0
    for line in text.split(b"\n")[: None if text and not text.endswith(b"\n") else -1]:
        want.append((at, line.removesuffix(b"\r")))
        at += len(line) + 1
    assert got == want


def test_large_texts_are_decoded_as_whole_files(spark, tmp_path):
    texts = {"u.txt": "đường\nphố", "v.txt": "abc\n", "w.txt": "caf\xe9\nna\xefve\n", "l.txt": "\x81\x8d\nx"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode("utf-8" if name < "v" and name != "l.txt" else "latin-1"))
    whole = {r["path"]: (r["text"], r["charset"]) for r in S.read_text_fallback(spark, str(tmp_path)).collect()}
    lines = {}
    for r in S.read_lines_fallback(spark, str(tmp_path)).orderBy("path", "offset").collect():
        lines.setdefault(r["path"], []).append((r["text"], r["charset"]))
    assert {p: ("\n".join(t for t, _ in rows), rows[0][1]) for p, rows in lines.items()} == {p: (t.removesuffix("\n"), c) for p, (t, c) in whole.items()}


CARD = ["No: 0010 9501 {:04d}", "Ho va ten / Full name:", "TRAN VAN MAU", "Ngay sinh / Date of birth: 05/07/1990", "Gioi tinh / Sex: Nu Quoc tich / Nationality: Viet Nam", "Co gia tri den: 05/07/2030"]


def arrive(landing, name, *parts):
    """Parts (doc_id, minute, part, parts, lines) as a file."""
    landing.mkdir(exist_ok=True)
    start = datetime(2024, 1, 1)
    rows = [{"doc_id": d, "arrived": (start + timedelta(minutes=m)).strftime("%Y-%m-%dT%H:%M:%S.000Z"), "part": p, "parts": n, "lines": lines} for d, m, p, n, lines in parts]
    (landing / name).write_text("".join(json.dumps({k: v for k, v in r.items() if v is not None}) + "\n" for r in rows))


def test_documents_in_parts_become_whole(spark, tmp_path):
    """Each card is split over two files, the second half first for some; batch and stream agree."""
    cards = {d: [line.format(d) for line in CARD] for d in range(40)}
    first = [(d, 0, 0, 2, lines[:3]) for d, lines in cards.items()]
    second = [(d, 1, 1, 2, lines[3:]) for d, lines in cards.items()]
    swapped = lambda a, b: [x if x[0] % 3 else y for x, y in zip(a, b)]
    arrive(tmp_path / "in", "a.json", *swapped(first, second), first[1])
    run = lambda: P.stream_parts(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    run()
    records = lambda: spark.read.parquet(str(tmp_path / "out" / "records"))
    assert records().count() == 0
    arrive(tmp_path / "in", "b.json", *swapped(second, first))
    run()
    batch = R.records_of(spark.createDataFrame([(d, datetime(2024, 1, 1), lines) for d, lines in cards.items()], R.ARRIVAL))
    key = lambda df: sorted(map(str, df.select(*batch.columns).collect()))
    assert key(records()) == key(batch) and {r["outcome"] for r in records().collect()} == {"whole"}


def test_documents_that_wait_and_parts_that_are_late(spark, tmp_path):
    whole = [line.format(7) for line in CARD]
    landing, run = tmp_path / "in", lambda: P.stream_parts(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    read = lambda kind: spark.read.parquet(str(tmp_path / "out" / kind)).collect()
    arrive(landing, "a.json", (7, 0, 0, 2, whole[:4]), (8, 0, 0, None, whole))
    run()
    assert read("records") == []
    arrive(landing, "b.json", (9, 25, 0, 1, whole))  # the watermark passes the wait of 7 and 8
    run()
    assert {(r["doc_id"], r["outcome"]) for r in read("records")} == {(7, "waited"), (8, "waited"), (9, "whole")}
    arrive(landing, "c.json", (9, 26, 1, 1, ["x"]))
    run()
    assert [(r["doc_id"], r["part"], r["lines"]) for r in read("late")] == [(9, 1, ["x"])] and len(read("records")) == 3


def test_documents_of_one_group_leave_each_in_its_own_time(spark, tmp_path, monkeypatch):
    """Every document was a call of the stateful function; now a group of them is, and each keeps its own state."""
    whole = [line.format(7) for line in CARD]
    found = []
    for groups in (1, 1 << 30):
        monkeypatch.setattr(P, "GROUPS", groups)
        base = tmp_path / str(groups)
        run = lambda: P.stream_parts(spark, str(base / "in"), str(base / "out"), str(base / "state")).awaitTermination()
        base.mkdir()
        arrive(base / "in", "a.json", (1, 0, 0, 2, whole[:3]), (2, 0, 0, None, whole), (3, 0, 1, 2, whole[3:]), (4, 0, 0, 1, whole), (5, 5, 0, 2, whole[:3]))
        run()
        arrive(base / "in", "b.json", (1, 8, 1, 2, whole[3:]), (6, 25, 0, 1, whole), (4, 12, 1, 1, ["late"]))  # 2 and 3 have waited, 5 not yet
        run()
        arrive(base / "in", "c.json", (5, 15, 1, 2, whole[3:]), (4, 26, 2, 1, ["later"]), (6, 26, 1, 1, ["x"]), (7, 50, 0, 3, whole))
        run()
        arrive(base / "in", "d.json", (7, 51, 1, 3, ["y"]), (8, 90, 0, 1, whole), (4, 90, 0, 1, whole))
        run()
        read = lambda kind, *columns: sorted(map(str, spark.read.parquet(str(base / "out" / kind)).select(*columns).collect()))
        found.append((read("records", "doc_id", "outcome", "idNumber"), read("late", "doc_id", "part", "lines")))
    assert found[0] == found[1] and len(found[0][0]) >= 8 and len(found[0][1]) >= 3
    assert {s.split("outcome='")[1].split("'")[0] for s in found[0][0]} == {"whole", "waited"}


def test_a_group_is_one_call_and_one_row_of_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "GROUPS", 2)
    arrive(tmp_path / "in", "a.json", *((d, 0, 0, 2, ["x"]) for d in range(50)))
    query = P.stream_parts(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 2
