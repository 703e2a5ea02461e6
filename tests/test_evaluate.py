"""Top-share statistics."""

from cellcast.operators import evaluate as E


def test_top_share_prefix_sums(spark):
    vals = [5.0, 3.0, 2.0, 0.5]
    rows = [(1, "obs", 0, i, v) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "period_h int, layer string, row int, col int, value double")
    r100 = E.top_share(df, 100).first()   # k = 1, 5, 10, 20
    assert r100["one_percent"] == 5.0 and r100["five_percent"] == 10.5 and r100["total"] == 10.5
    r40 = E.top_share(df, 40).first()     # k = 0, 2, 4, 8
    assert r40["one_percent"] == 0.0 and r40["five_percent"] == 8.0


def test_top_k_sizes_truncate():
    assert E.top_k_sizes(313024) == {"one_percent": 3130, "five_percent": 15651,
                                     "ten_percent": 31302, "twenty_percent": 62604}


def test_histogram_of_values_equals_ranking(spark):
    import random

    from cellcast.operators import evaluate as E
    rng = random.Random(2)
    rows = [(h, "a", r, c, float(rng.choice([1, 1, 1, 2, 2, 5, 0.5, rng.random()]))) for h in range(4) for r in range(9) for c in range(9)]
    rows += [(9, "a", 0, 0, 3.0), (10, "b", 0, 0, 2.0), (10, "b", 0, 1, 2.0)]
    df = spark.createDataFrame(rows, "period_h int, layer string, row int, col int, value double")
    for area in (100, 313, 7, 0):
        a, b = ({(r.period_h, r.layer): [round(r[c], 9) for c in E.STAT_COLUMNS] for r in f(df, area).collect()}
                for f in (E.top_share, E.ranked_top_share))
        assert a == b
