"""Diffs are read by themselves: odd ones, and plans without a deal of their lines."""

from assaykit.operators import diff

ODD = "junk\n-no\ndiff --git a/x b/y\nsimilarity 90%\nrename from x\nrename to y\r\n--- a/x\n+++ b/y\n@@ -3,2 +5,2 @@ f\n a\n-b\n+c\n\\ No newline\n@@ -9 +11 @@\n--- a/z\n+++ b/z\n@@ none\n+d\ndiff --git a/n b/n\nnew file mode 1\n@@ -0,0 +1 @@\n+e\ndiff --git a/g b/g\ndeleted file mode 1\n@@ -1 +0,0 @@\n-f\n"


def test_rows_of_an_odd_diff(spark):
    df = spark.createDataFrame([(1, ODD), (2, None), (3, ""), (4, "@@ -1 +1 @@\n+x")], "diff_id long, diff string")
    parsed = diff.parse(df)
    got = [tuple(r) for r in parsed.collect()]
    y = ("y", "x", "renamed")
    assert got == [
        (1, *y, 1, " ", 5, "a"), (1, *y, 1, "-", 4, "b"), (1, *y, 1, "+", 6, "c"), (1, *y, 2, "-", 9, "-- a/z"), (1, *y, 2, "+", 11, "++ b/z"), (1, *y, 3, "+", None, "d"),
        (1, "n", "n", "added", 1, "+", 1, "e"), (1, "g", "g", "deleted", 1, "-", 1, "f"),
    ]
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan


def test_many_rows_leave_in_pieces(spark):
    n = 3 * diff.ROWS + 5
    text = f"diff --git a/f b/f\n@@ -1,0 +1,{n} @@\n" + "\n".join(f"+{i}" for i in range(n))
    got = diff.parse(spark.createDataFrame([(7, text)], "diff_id long, diff string"))
    assert [(r.line_no, r.text) for r in got.select("line_no", "text").collect()] == [(i + 1, str(i)) for i in range(n)]
