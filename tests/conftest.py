import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tabwright.plans.session import local_session

    session = local_session("tests", "4", "4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


@pytest.fixture(scope="session")
def small(spark):
    """One row per shape the edge files have: holes, ties, constants, text numbers, dates."""
    rows = []
    for i in range(120):
        rows.append((
            i, 20 + i * 7 % 55, None if i % 10 == 3 else 1000.0 + i * i % 977, ("Female", "Male", "Other")[i % 3] if i % 8 else None,
            (i * 7 // 3) % 2, None if i % 6 in (0, 1) else f"2024-01-{i % 28 + 1:02d}", ("yes", "NO", "maybe", "perhaps")[i % 4], 5.0, None,
        ))
    schema = (
        "row_no bigint, customer_age bigint, income double, gender string, purchased int, seen string, answer string, "
        "same double, void double"
    )
    return spark.createDataFrame(rows, schema)
