from assaykit.llm import licenses


def test_repeated_and_second_notices_are_found(spark):
    mit, apache = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["Apache-2.0"]
    docs = [f"the x {mit[0]} {mit[0]} The end of it", f"a {mit[1]} b c {apache[0]} d", "nothing"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.scan(df).collect()}
    n = len(licenses.words_of(mit[1].encode()))
    assert (rows[0].license, rows[0].notices) == ("MIT", "MIT:2:6,MIT:7:11")
    assert (rows[1].license, rows[1].notices) == ("MIT", f"MIT:1:{n},Apache-2.0:{n + 3}:{n + 10}")
    assert (rows[2].license, rows[2].notices) == (None, "")
