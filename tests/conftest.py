import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from roomsense import schemas  # noqa: E402
from roomsense.session import ensure_checkpoint_dir, local_session  # noqa: E402
from roomsense.sources import seed  # noqa: E402
from roomsense.tables import Tables  # noqa: E402

AS_OF = dt.datetime(2026, 1, 15, 12, 0, 0)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(cores=8, shuffle_partitions=8, app="roomsense-tests")
    ensure_checkpoint_dir(s, str(tmp_path_factory.mktemp("checkpoints")))
    return s


def _t(s):
    return dt.datetime.strptime(f"2026-{s}", "%Y-%m-%d %H:%M:%S")


# FIXTURES.md §2: sensor 1 environment readings (id, ts, co2, voc, temp, humidity, noise)
ENV = [
    (1, "01-13 11:30:00", 500, 100, 20, 40, 50),
    (2, "01-14 11:30:00", 700, 200, 22, 50, 60),
    (3, "01-15 05:10:00", 900, 260, 24, 60, 65),
    (4, "01-15 05:50:00", 1100, 300, 26, 70, 70),
    (5, "01-15 07:00:00", 800, 250, 27, 75, 71),
    (6, "01-15 11:30:00", 1000, 400, 18, 30, 40),
]
OCC_S3 = [2, 5, 5, 7, 7, 8, 8, 6, 9, 9, 9, 10, 4, 11]


def env_rows(spark, rows=ENV, sensor=1):
    out = [(i, _t(ts), sensor, 60, 0.0, float(h), float(tp), float(v), float(c), 0.0, float(n), 0, 0, 0.0)
           for i, ts, c, v, tp, h, n in rows]
    return spark.createDataFrame(out, schemas.ENV_READINGS)


def occ_rows(spark):
    rows = [(1, _t("01-15 07:00:30"), 3, 60, 3, 0.0, 0.0, 0.0)]
    for m, p in enumerate(OCC_S3):
        rows.append((2 + m, _t(f"01-15 11:{m:02d}:00"), 3, 60, p, 0.0, 0.0, 0.0))
    rows.append((100, _t("01-15 11:00:00"), 6, 60, 12, 0.0, 0.0, 0.0))
    rows.append((101, _t("01-15 11:05:00"), 6, 60, 12, 0.0, 0.0, 0.0))
    return spark.createDataFrame(rows, schemas.OCCUPANCY_READINGS)


def golden(spark, second_block=False) -> Tables:
    return Tables(sectors=seed.sectors(spark), sensors=seed.sensors(spark), env=env_rows(spark),
                  occ=occ_rows(spark), thresholds=seed.thresholds(spark),
                  alerts=seed.alerts(spark, AS_OF, second_block=second_block))


def empty(spark) -> Tables:
    g = golden(spark)
    return g.replace(env=g.env.where("false"), occ=g.occ.where("false"), alerts=g.alerts.where("false"))


@pytest.fixture(scope="session")
def gold(spark):
    return golden(spark)


@pytest.fixture(scope="session")
def gold2(spark):
    return golden(spark, second_block=True)


@pytest.fixture(scope="session")
def blank(spark):
    return empty(spark)
