"""Every registered query agrees with DuckDB, and no plan multiplies rows."""

from pathlib import Path

import pytest

import oracle
from fleetscope.plans.catalog import ORACLES, RUNS

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", list(RUNS))
def test_query(spark, duck, name):
    verdict, count = oracle.compare(spark, duck, name, FOLDER)
    assert verdict == "ok" and count > 0


def test_every_query_has_an_oracle():
    assert set(RUNS) == set(ORACLES)


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The same tables, the streamed ones as folders of several files."""
    out = tmp_path_factory.mktemp("folders")
    for path in Path(FOLDER).glob("*.parquet"):
        if path.stem in ("conversations", "events"):
            spark.read.parquet(str(path)).repartition(3).write.parquet(str(out / path.name))
        else:
            (out / path.name).symlink_to(path)
    return str(out)


@pytest.mark.parametrize("name", [name for name in RUNS if name.startswith("stream_")])
def test_stream_of_a_folder(spark, duck, folders, name):
    verdict, count = oracle.compare(spark, duck, name, folders)
    assert verdict == "ok" and count > 0
