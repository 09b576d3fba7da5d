"""Arriving pages give the same answers as a batch."""

from factsieve.streaming.landing import extract_stream, stream_pages


def test_landing_folder(spark, tmp_path):
    rows = [(i, f"http://a.example/{i}", f"<h1>Shop number {i}</h1>") for i in range(3)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "in"))
    query = extract_stream(stream_pages(spark, str(tmp_path / "in")), ["Name"], str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.site, r.value, r.method) for r in got} == {(i, f"Shop number {i}", "h1") for i in range(3)}
