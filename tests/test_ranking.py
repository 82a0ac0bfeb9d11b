import os
import random

import pandas as pd

from hotloom.operators.ranking import average_ranks, with_rank
from hotloom.session import shared_folder, stage, unstage


def test_ranks_over_ranges(spark):
    rng = random.Random(1)
    values = [rng.choice([None, *range(40)]) for _ in range(500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v int")
    got = with_rank(df, ["v", "id"], "r", "n").orderBy("r").collect()
    assert [x.r for x in got] == list(range(1, 501)) and {x.n for x in got} == {500}
    assert [(x.v, x.id) for x in got] == sorted(((v, i) for i, v in enumerate(values)), key=lambda t: (t[0] is not None, t[0] or 0, t[1]))
    want = pd.Series([v for v in values if v is not None]).rank().groupby(pd.Series([v for v in values if v is not None])).first()
    assert {x.v: x.a for x in average_ranks(df, "v", "a").collect()} == want.to_dict()
    assert with_rank(df.limit(0), ["v"]).count() == 0 and average_ranks(df.limit(0), "v", "a").count() == 0


def test_staged_tables_lie_in_the_named_folder(spark):
    folder = shared_folder(spark).removeprefix("file:").lstrip("/")
    staged = stage(spark.range(10), "t")
    files = [f.removeprefix("file:").lstrip("/") for f in staged.inputFiles()]
    assert files and all(f.startswith(folder) for f in files) and staged.count() == 10
    unstage(staged)
    assert not any(os.path.exists("/" + f) for f in files)
