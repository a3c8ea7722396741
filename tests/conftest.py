import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from affinis.workspace import session  # noqa: E402

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    return session("affinis-tests", cores=8, spark__sql__shuffle__partitions="4", spark__ui__showConsoleProgress="false")


@pytest.fixture
def vectors(spark):
    rows = [
        (1, "Alpha", [1.0, 0.0, 0.0, 0.0]),
        (2, "Beta", [0.0, 1.0, 0.0, 0.0]),
        (3, "Gamma", [0.0, 0.0, 1.0, 0.0]),
        (4, "Delta", [0.0, 0.0, 0.0, 1.0]),
        (5, "Epsilon", [0.5, 0.5, 0.5, 0.5]),
    ]
    return spark.createDataFrame(rows, "id long, name string, v array<float>")


@pytest.fixture
def stored_rows(spark):
    rows = [
        (1, "1", "Steel bolt", "Hardware", [0.1, 0.2, 0.3, 0.4]),
        (2, "2", "Steel bolts", "Hardware", [0.11, 0.21, 0.31, 0.41]),
        (3, "3", "Music box", "Toys", [0.9, 0.8, 0.7, 0.6]),
    ]
    return spark.createDataFrame(
        rows, "n long, ID string, Name string, Category string, embedding array<float>"
    )
