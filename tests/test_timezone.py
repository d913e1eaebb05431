"""Results do not depend on the session time zone (C2): every time is
TIMESTAMP_NTZ and buckets are built from its fields."""

import pytest

from roomsense.operators import alerts as al
from roomsense.operators import environment as en
from roomsense.operators import occupancy as oc
from roomsense.streaming import hourly
from tests.conftest import AS_OF

REPORTS = [
    lambda t: en.env_hourly(t, "30d", as_of=AS_OF),
    lambda t: en.env_summary(t, as_of=AS_OF),
    lambda t: oc.co2_people_by_minute(t),
    lambda t: al.alert_daily(t, as_of=AS_OF),
    lambda t: hourly.hourly_state(t.env),
]


@pytest.mark.parametrize("i", range(len(REPORTS)))
def test_half_hour_zone_gives_same_rows(spark, gold, i):
    base = sorted(map(tuple, REPORTS[i](gold).collect()), key=repr)
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        other = sorted(map(tuple, REPORTS[i](gold).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert other == base
