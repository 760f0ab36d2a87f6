import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plumbline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def shared_folder(tmp_path_factory):
    return tmp_path_factory.mktemp("shared")


@pytest.fixture(scope="session")
def spark(shared_folder):
    session = local_session(memory="8g", options={"spark.checkpoint.dir": str(shared_folder)})
    yield session
    session.stop()


@pytest.fixture
def unit(spark):
    """Six readings of three gauges: one level is missing."""
    levels = [0.5, 1.5, 4.0, None, 2.25, 0.5]
    rows = [(10 * i, f"gauge {'xyz'[i % 3]}", f"2019-11-{25 + i}", level) for i, level in enumerate(levels)]
    return spark.createDataFrame(rows, "id bigint, place string, noted string, level double")


class Shipments:
    """Generated parcel lists. What tests expect of them is computed from ``rows``."""

    columns = ("parcel", "depot", "kilos", "priority", "sent", "zone", "paid")

    def __init__(self, n: int = 12):
        depots, zones = ("Oslo", "Riga", "Turin"), ("north", "south")
        self.rows = [
            (
                500 + i, depots[i % 3], round(0.5 + i * 1.25, 2) * (-1 if i == 4 else 1), i % 5, f"2018-{i % 12 + 1:02d}-14",
                None if i % 6 == 5 else zones[i % 2], i % 4 != 0,
            )
            for i in range(n)
        ]

    def column(self, name: str) -> list:
        return [r[self.columns.index(name)] for r in self.rows]

    def text(self, sep: str = ",", without: tuple[str, ...] = ()) -> str:
        kept = [i for i, c in enumerate(self.columns) if c not in without]
        lines = [[self.columns[i] for i in kept]]
        lines += [["" if r[i] is None else str(r[i]) for i in kept] for r in self.rows]
        return "".join(sep.join(line) + "\n" for line in lines)


@pytest.fixture
def shipments():
    return Shipments()


@pytest.fixture
def files(tmp_path, shipments):
    """Paths of the generated lists by name."""
    twice = Shipments()
    twice.rows = [r for i, r in enumerate(twice.rows) for _ in range(1 + (i % 4 == 1))]
    texts = {"commas": shipments.text(), "bars": shipments.text("|"), "copies": twice.text(";")}
    paths = {}
    for name, content in texts.items():
        path = tmp_path / f"{name}.csv"
        path.write_text(content)
        paths[name] = str(path)
    return paths
