from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from tickerloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def random_bars():
    """Two random price series of different length as pandas frames."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    frames = []
    for ticker, n in (("AAA", 2600), ("BBB", 420)):
        close = 100 * np.exp(np.cumsum(rng.normal(0.0003, 0.02, n)))
        open_ = close * (1 + rng.normal(0, 0.005, n))
        frames.append(
            pd.DataFrame(
                {
                    "ticker": ticker,
                    "date": pd.bdate_range("2010-01-04", periods=n).date,
                    "open": open_,
                    "high": np.maximum(open_, close) * (1 + abs(rng.normal(0, 0.006, n))),
                    "low": np.minimum(open_, close) * (1 - abs(rng.normal(0, 0.006, n))),
                    "close": close,
                    "volume": rng.integers(1_000_000, 9_000_000, n).astype(float),
                }
            )
        )
    return frames


@pytest.fixture(scope="session")
def bars(spark, random_bars):
    import pandas as pd

    from tickerloom.operators.series import with_positions

    return with_positions(spark.createDataFrame(pd.concat(random_bars)))
