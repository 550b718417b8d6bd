"""op1_line_dedup takes out short repeated lines too; blank lines alone stay."""

from gridweave.llm import line_dedup


def test_short_runs_go_and_blank_lines_stay(spark, tmp_path):
    rows = [(1, "first text of its own\nLicensed under CC BY-NC 4.0.\n\none"), (2, "second text of its own\nLicensed under CC BY-NC 4.0.\n\nmore"), (3, "third text\n\none"), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(str(tmp_path / "d"))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.read.parquet(str(tmp_path / "d"))).collect()}
    from test_llm import brute_lines

    assert [got[i] for i, _ in rows] == brute_lines(rows, 1)
    assert got[2] == "second text of its own\nmore" and got[3] == "third text"
