import os
import sys
from statistics import NormalDist

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tabsense.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", 8, app="tabsense-tests")
    yield s


@pytest.fixture(scope="session")
def unit_pdf() -> pd.DataFrame:
    """200 rows by formula: ages, incomes spread like a normal law with five missing and
    one far outlier (row 5), a city and a flag that follows from both."""
    law = NormalDist(5000, 1500)
    rows = []
    for i in range(200):
        age = 18 + i * 37 % 52
        income = law.inv_cdf((i * 89 % 200 + 0.5) / 200)
        flag = int(income > 5000 and age > 30)
        if i % 40 == 7:
            income = None
        rows.append((age, 90000.0 if i == 5 else income, ("Toshkent", "Samarqand", "Buxoro")[i * i % 7 % 3], flag))
    return pd.DataFrame(rows, columns=["yosh", "daromad", "shahar", "sotib_oldi"]).astype({"daromad": float})


@pytest.fixture(scope="session")
def unit_df(spark, unit_pdf):
    """Spark copy; the pandas NaN arrives as a double NaN, which operators treat as missing."""
    return spark.createDataFrame(unit_pdf.assign(rid=range(len(unit_pdf))))
