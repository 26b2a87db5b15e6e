"""Metamorphic checks: results do not depend on how the input
is partitioned."""
import math

import numpy as np
import pandas as pd

from tabsense.operators import charts as C
from tabsense.operators import metrics as M
from tabsense.operators import profile as P


def _rows(df):
    out = []
    for r in df.collect():
        out.append(tuple(round(v, 9) if isinstance(v, float) and not math.isnan(v) else v for v in r))
    return sorted(out, key=repr)


def test_full_profile_ignores_partitioning(unit_df):
    base = _rows(P.full_profile(unit_df))
    assert base == _rows(P.full_profile(unit_df.repartition(7)))
    assert base == _rows(P.full_profile(unit_df.coalesce(1)))


def test_auc_and_box_ignore_partitioning(spark):
    rng = np.random.default_rng(31)
    n = 3000
    pdf = pd.DataFrame({"label": rng.integers(0, 2, n), "score": np.round(rng.random(n), 2),
                        "g": rng.choice(["a", "b", "c"], n), "v": rng.lognormal(2, 1, n)})
    df = spark.createDataFrame(pdf)
    for other in (df.repartition(11), df.coalesce(1)):
        assert _rows(M.roc_auc(df, "label", "score")) == _rows(M.roc_auc(other, "label", "score"))
        assert _rows(C.box_plot(df, "g", "v")) == _rows(C.box_plot(other, "g", "v"))
