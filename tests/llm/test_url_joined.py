from assaykit.llm import url_filter


def test_a_frequent_joined_host_is_still_split(spark):
    urls = [f"http://{'freebets' if i % 3 == 0 else f'site{i}'}.net/" for i in range(30000)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = url_filter.judge(df).where("page_id % 3 = 0").select("words", "verdict").distinct().collect()
    assert [tuple(r) for r in rows] == [("free bets", "block")]
