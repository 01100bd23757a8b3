import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barloom.session import local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


def series(n: int, symbols=("A",), freq="h", seed=1) -> pd.DataFrame:
    """A deterministic walk per symbol."""
    import numpy as np

    parts = []
    for i, s in enumerate(symbols):
        rng = np.random.default_rng(seed + i)
        close = 100 + rng.normal(0, 1, n).cumsum().clip(-60, 500)
        open_ = close + rng.normal(0, 0.5, n)
        parts.append(
            pd.DataFrame(
                {
                    "Symbol": s,
                    "Date": pd.date_range("2020-01-01", periods=n, freq=freq),
                    "Open": open_,
                    "High": np.maximum(open_, close) + 1,
                    "Low": np.minimum(open_, close) - 1,
                    "Close": close,
                    "Volume": rng.integers(1, 1000, n).astype(float),
                }
            )
        )
    return pd.concat(parts, ignore_index=True)


BARS = "Symbol string, Date {} , Open double, High double, Low double, Close double, Volume double"


def bars(spark, pdf, daily=False):
    pdf = pdf.copy()
    if daily:
        pdf["Date"] = pdf["Date"].dt.date
    return spark.createDataFrame(pdf, BARS.format("date" if daily else "timestamp"))


def ordered(df, keys=("Symbol", "Date")):
    return df.toPandas().sort_values(list(keys)).reset_index(drop=True)
