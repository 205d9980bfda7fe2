"""Changed loads are named whatever other loads hold and however many values a column has."""

import random

from ctmcflow.operators import profile


def test_changed_shares_and_repeats(spark):
    rnd = random.Random(9)
    fixed = [rnd.gauss(0, 1) for _ in range(40)]
    rows = []
    for l in range(12):
        for _ in range(600):
            na = rnd.choices([1, 2, 3], [0.93, 0.04, 0.03] if l != 5 else [0.78, 0.11, 0.11])[0]
            if l in (8, 9):
                na = rnd.randint(1, 100_000)  # many values over all loads
            rows.append((l, na, rnd.choice(fixed) if l == 3 else rnd.gauss(0, 1)))
        if l == 1:
            rows += [(l, 1 + (i % 100 >= 93) + (i % 100 >= 97), rnd.gauss(0, 1)) for i in range(3000)]  # a large load is no changed one
    df = spark.createDataFrame(rows, "load_id int, na long, v double")
    p = profile.profile(df, ["na", "v"], quantiles=False)
    assert {(r["load_id"], r["column_name"]) for r in profile.changed_loads(p).collect()} == {(5, "na"), (8, "na"), (9, "na"), (3, "v")}
