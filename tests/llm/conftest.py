import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def corpus(spark, tmp_path_factory):
    """Rows of documents plus nulls, empty and very long texts, ties, repeated rows and clashing columns."""
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    long_text = " ".join(f"word{k % 977} is  here\t{k}\n" for k in range(20_000))
    rows += [
        (None, "a text without an id of its own to be read by all", "en", "src1", 5), (1_000, None, None, None, None), (1_001, "", "en", "src0", 0), (1_002, " \t\n ", "en", None, 4),
        (1_003, long_text, "en", "src2", len(long_text)), (1_004, long_text.replace("\n", " "), "en", "src2", 1), (1_005, "Same TEXT here, CC BY and all rights reserved.", "en", "src3", 1), (1_005, "Same TEXT here, CC BY and all rights reserved.", "en", "src3", 1),
        (1_006, "Same  TEXT here, CC BY and all rights\nreserved.", "en", "src4", 1), (1_007, "<|endoftext|> É\u0301 \x1c x\u212a \u0130 GENERAL public\x00license cc-by", "xx", "src4", 1), (-5, "minus five", "en", "", 1),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    wide = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS __row", "'x' AS row", "2 AS part", "'y' AS shard", "3 AS node", "4 AS w0", "'z' AS size", "5 AS words", "6 AS hashes", "7 AS copies", "8 AS bucket", "9 AS p")
    path = str(tmp_path_factory.mktemp("corpus"))
    wide.repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_rows(corpus):
    return corpus.where("doc_id = 123456789")
