"""Queries over documents on texts that the test tables do not have."""

import duckdb

from sheaf import queries as Q

TEXTS = [None, "", " ", "\n", "\r\n", "plain", "View this\nx", "x\nSharing\ny", "x\nTerms and Conditions\ny", "x\nFlu vaccine due\r", "Show", " menu \n\n a  b\t", "x\nMore\nMORE\n"]


def test_trimmed_texts_that_are_blank_or_look_like_a_page(spark, tmp_path):
    rows = [(2 * i + odd, text) for i, text in enumerate(TEXTS) for odd in (0, 1)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["digest"] for r in Q.p15_trim_boilerplate(spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(db.execute(Q.SQL["p15_trim_boilerplate"]).fetchall())


def test_texts_with_accents_are_not_squashed_for_them(spark):
    """Letters with accents alone are nothing to squash; what is there is squashed as before, and dates of all forms are found."""
    from pyspark.sql import functions as F

    from sheaf.functions import dates, text

    rows = [("é à\nü", "é à\nü"), (" é\xa0à \r\n b ", "é à\nb"), ("é  à", "é à"), ("é\n", "é")]
    frame = spark.createDataFrame(rows, "t string, want string")
    assert frame.where(text.normalize_text(F.col("t")) != F.col("want")).count() == 0
    assert not spark.range(1).select(F.lit("é à\nü").rlike(text.UNEVEN)).first()[0]
    dated = spark.createDataFrame([("Seen 3/4/24", "3/4/24"), ("Jan 3 2024", "Jan 3 2024"), ("Jan 3, 2024", "Jan 3, 2024"), ("no 13/45", ""), ("May 3", "")], "t string, want string")
    assert dated.where(dates.extract_date(F.col("t")) != F.col("want")).count() == 0
