"""Row pairs of neighbouring pages: those of a plain loop, made without a join."""

from rowloom.operators import stitch


def test_row_pairs(spark):
    sizes = {("x", 0): 5, ("x", 1): 3, ("x", 4): 12, ("x", 5): 2, ("y", 0): 4, ("y", 1): 4}
    rows = [(b, p, r, f"{b}{p}-{r}") for (b, p), n in sizes.items() for r in range(1, n + 1)]
    found = stitch.row_pairs(spark.createDataFrame(rows, "batch string, page int, row int, payload string"), 4)
    got = sorted((r["batch"], r["page"], r["k"], r["a"]["payload"], r["b"]["payload"]) for r in found.collect())
    want = []
    for b, p, q in (("x", 0, 1), ("x", 1, 4), ("x", 4, 5), ("y", 0, 1)):
        for k in range(1, min(4, sizes[b, p], sizes[b, q]) + 1):
            want += [(b, p, k, f"{b}{p}-{sizes[b, p] - k + j + 1}", f"{b}{q}-{j + 1}") for j in range(k)]
    assert got == sorted(want)
    assert "Join" not in found._jdf.queryExecution().toString()
