from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stockflow.operators import daily, flows, monthly  # noqa: E402
from stockflow.session import local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
SMALL_SF_DIR = "/root/testdata/sf0.01"

# Load order, date, code, warehouse, stock, price, name.
SNAPSHOTS = [
    (1, "2025-01-30", "A1", "W1", 10, 100, "Filter"),
    (2, "2025-01-30", "A1", "W1", 99, 101, "Filter X"),
    (3, "2025-01-31", "A1", "W1", 7, 110, "Filter"),
    (4, "2025-02-01", "A1", "W1", 7, 110, "Filter"),
    (5, "2025-02-02", "A1", "W1", 12, None, "Filter"),
    (6, "2025-01-30", "B2", "W1", 4, None, "filter "),
    (7, "2025-01-30", "B2", "W1", 40, 20, None),
    (8, "2025-01-31", "B2", "W1", None, 20, "filter "),
    (9, "2025-02-01", "B2", "W1", 1, 0, "filter "),
    (10, "2025-02-02", "B2", "W1", 1, 0, "filter "),
    (11, "2025-01-30", "A1", "W2", 5, 0, "Filter дефект"),
    (12, "2025-01-31", "A1", "W2", 8, 50, "Filter дефект"),
    (13, "2025-02-01", "A1", "W2", 6, 60, "Filter дефект"),
    (14, "2025-02-02", "A1", "W2", 6, 60, "Filter дефект"),
    (15, None, "C3", "W1", 1, 1, "Gasket"),
]
SNAPSHOT_SCHEMA = (
    "seq int, dt timestamp_ntz, item_code string, warehouse string, stock double, price double, "
    "item_name string, manufacturer string"
)


def day(text: str | None) -> dt.datetime | None:
    return None if text is None else dt.datetime.fromisoformat(text)


def number(value) -> float | None:
    return None if value is None else float(value)


def rows(df, *columns: str) -> list[tuple]:
    """Rows in the given columns, sorted with missing values first."""
    found = [tuple(r) for r in df.select(*columns).collect()]
    return sorted(found, key=lambda r: tuple((v is not None, v) for v in r))


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "stockflow-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def snapshots(spark):
    data = [
        (seq, day(d), code, wh, number(stock), number(price), name, "Maker")
        for seq, d, code, wh, stock, price, name in SNAPSHOTS
    ]
    return spark.createDataFrame(data, SNAPSHOT_SCHEMA)


@pytest.fixture(scope="session")
def days(snapshots):
    return daily.daily_snapshot(snapshots, ["seq"])


@pytest.fixture(scope="session")
def movements(days):
    return flows.with_flows(days)


@pytest.fixture(scope="session")
def months(movements):
    return monthly.monthly_summary(flows.net_of_transfers(movements))


@pytest.fixture(scope="session")
def totals(months):
    return monthly.item_totals(months)
