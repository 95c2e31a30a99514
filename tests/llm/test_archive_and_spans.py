"""Decoding from checkpoints, and license spans: one row an occurrence, in order."""

import numpy as np
import pytest
from pergament.llm import license_scan, rans, registry

WORDS = registry.vocabulary("word_bpe_49k.json")


class Spy:
    """A segment in memory that remembers what was read of it."""

    def __init__(self, data: bytes):
        self.data, self.reads = data, []

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        self.reads.append((at, n))
        return self.data[at : at + n]


def test_blocks_are_decoded_from_their_checkpoints():
    rng = np.random.default_rng(6)
    ids = np.minimum(rng.zipf(1.3, 5 * rans.BLOCK + 777), 3000).astype(np.uint32)
    table = rans.Table(rans.quantise(np.bincount(ids)))
    lengths = np.array([len(ids) - 10, 10])
    data = b"".join(rans.segment_bytes(1_000, np.array([7, 9]), lengths, ids, table))
    file = Spy(data)
    segment = rans.Segment(file, table)
    file.reads.clear()
    a, b = 2 * rans.BLOCK + 5, 3 * rans.BLOCK - 5
    assert (segment.tokens(1_000 + a, 1_000 + b) == ids[a:b]).all() and len(file.reads) == 1  # the middle block alone
    for a, b in ((0, 1), (rans.BLOCK - 1, rans.BLOCK + 1), (0, len(ids)), (len(ids) - 1, len(ids)), (5, 5)):
        assert (segment.tokens(1_000 + a, 1_000 + b) == ids[a:b]).all()
    with pytest.raises(ValueError):
        segment.tokens(999, 1_001)
    hurt = bytearray(data)
    hurt[int(segment.checkpoints[2]["offset"]) + rans.LANES * 8 + 40] ^= 1
    hurt = rans.Segment(Spy(bytes(hurt)), table)
    assert (hurt.tokens(1_000, 1_000 + 2 * rans.BLOCK) == ids[: 2 * rans.BLOCK]).all()
    with pytest.raises(ValueError):
        hurt.tokens(1_000 + 2 * rans.BLOCK, 1_000 + 2 * rans.BLOCK + 1)


def test_token_ranges_of_an_archive(spark, corpus, monkeypatch):
    monkeypatch.setattr(rans, "GROUP", 1)
    manifest, freq = rans.write_archive(corpus, WORDS, 1)
    docs = sorted(rans.read_archive(spark, manifest, freq, with_ids=True).collect(), key=lambda r: r["start"])
    ids = [i for r in docs for i in r["ids"]]
    for start, end in ((0, len(ids)), (100, 70_000), (len(ids) - 3, len(ids) + 50), (len(ids), len(ids) + 1)):
        got = sorted(rans.read_tokens(manifest, freq, start, end).collect(), key=lambda r: r["start"])
        assert [i for r in got for i in r["ids"]] == ids[start:end] and len(got) >= min(1, len(ids[start:end]))


def spans_of(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(r["label"], r["start"], r["end"], r["in_order"]) for r in license_scan.spans(df).where("found").orderBy("label", "start").collect()]


def test_one_span_an_occurrence(spark):
    notice = "Permission is hereby granted, free of charge, to any {}person obtaining a copy of this {}software and associated documentation files"
    one = notice.format("living ", "fine ")
    assert spans_of(spark, "a b c " + one) == [("mit", 3, 24, 17)]
    twice = spans_of(spark, one + " " + "w " * 30 + notice.format("", ""))
    assert [x[0] for x in twice] == ["mit", "mit"] and twice[1][1] > twice[0][2]
    assert len(spans_of(spark, "cc by cc by cc by")) == 3


def test_a_span_is_held_in_order(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "DRIFT", 40)
    words = license_scan.TEMPLATES[2][0].split(" ")
    pieces = [words[k : k + 3] for k in range(0, len(words), 2)]
    plain = " ".join(words)
    turned = " ".join(w for p in reversed(pieces) for w in p)
    assert [x[0] for x in spans_of(spark, plain)] == ["bsd"]
    assert "bsd" not in [x[0] for x in spans_of(spark, turned)]  # every 2-gram is there, in no order
