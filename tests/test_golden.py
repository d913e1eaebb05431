"""Golden fixture (FIXTURES.md §2): hand-worked expectations per report."""

from pyspark.sql import functions as F

from roomsense.operators import alerts as al
from roomsense.operators import compliance as co
from roomsense.operators import dashboard as da
from roomsense.operators import environment as en
from roomsense.operators import occupancy as oc
from roomsense.operators import quality as qa
from roomsense.operators import thresholds as th
from tests.conftest import AS_OF


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_q01_sensor_counts(gold):
    assert rows(da.sector_directory(gold), "sector_id", "sensor_count") == [(1, 2), (2, 1), (3, 1), (4, 1), (5, 1)]


def test_q02_summary(gold):
    r = en.env_summary(gold, as_of=AS_OF).first()
    assert (r.co2_avg, r.voc_avg, r.temperature_avg, r.humidity_avg) == (900.0, 282.0, 23.4, 57.0)
    assert (r.co2_change_pct, r.voc_change_pct, r.temperature_change_pct, r.humidity_change_pct) == (
        50.0, 88.0, 11.4, 26.7)
    assert r.reading_time == "11:30"


def test_q02_trends(gold):
    r = en.env_summary_trends(gold, as_of=AS_OF).first()
    assert r.co2_trend == "up"


def test_q03_occupancy_now(gold):
    got = {r.sector_id: r for r in oc.occupancy_now(gold).collect()}
    assert (got[1].people, got[1].max_capacity, got[1].occupancy_pct, got[1].reading_time, got[1].band) == (
        11, 10, 110.0, "11:13", "red")
    assert (got[2].people, got[2].occupancy_pct) == (12, 40.0)
    assert (got[3].people, got[3].occupancy_pct, got[3].reading_time) == (0, 0.0, "--")


def test_q03_single_and_missing_sector(gold):
    r = oc.occupancy_now(gold, sector_id=1).collect()
    assert [(x.sector_id, x.people) for x in r] == [(1, 11)]
    m = oc.occupancy_now(gold, sector_id=99).first()
    assert (m.people, m.max_capacity, m.occupancy_pct, m.reading_time) == (0, 25, 0.0, "--")


def test_q04_history(gold):
    h = oc.occupancy_history(gold, sector_id=1).collect()
    assert len(h) == 15
    ts = [r.ts for r in h]
    assert ts == sorted(ts)


def test_q05_hourly(gold):
    got = rows(en.env_hourly(gold, "24h", as_of=AS_OF), "label", "co2", "voc", "temp", "humid")
    assert got == [("14/01 11:30", 700.0, 200.0, 22.0, 50.0), ("15/01 05:10", 1000.0, 280.0, 25.0, 65.0),
                   ("15/01 07:00", 800.0, 250.0, 27.0, 75.0), ("15/01 11:30", 1000.0, 400.0, 18.0, 30.0)]


def test_q05_unknown_period(gold):
    import pytest
    with pytest.raises(ValueError):
        en.env_hourly(gold, "2h")


def test_v08_current(gold):
    assert en.env_current(gold, as_of=AS_OF).first().label == "15/01 11:30"


def test_q06a_score(gold):
    r = en.env_score(gold).first()
    assert (r.score, r.status) == (0, "ATENCAO")


def test_q06b_peaks(gold):
    r = en.peak_by_sector(gold, as_of=AS_OF).first()
    assert (r.co2_peak_sector, r.co2_peak_value, r.voc_peak_sector, r.voc_peak_value) == (
        "UTI Adulto - Ala A", 1100.0, "UTI Adulto - Ala A", 400.0)


def test_q06cd_counts(gold):
    assert da.odour_events(gold, as_of=AS_OF).first().odour_events == 1
    assert da.active_sensors(gold).first().active_sensors == 6


def test_q06_summary_row(gold):
    r = da.dashboard_summary(gold, as_of=AS_OF).first()
    assert (r.score, r.status, r.odour_events, r.active_sensors, r.co2_peak_value) == (0, "ATENCAO", 1, 6, 1100.0)
    assert r.status_display == "ATENCAO"


def test_q07_heatmap(gold, gold2):
    h = {r.sector_id: r for r in da.sector_heatmap(gold, as_of=AS_OF).collect()}
    assert all(list(r.co2_history) == [1100.0, 800.0, 1000.0] for r in h.values())
    assert [h[i].alerts_24h for i in range(1, 6)] == [2, 2, 1, 0, 1]
    assert h[1].people == 11 and h[2].people == 12 and h[3].people == 0
    assert h[1].status == "ATENCAO" and h[1].co2 == 1000.0
    assert h[1].tile_text == "2 ALERTAS (24h)" and h[4].tile_text == "Sistema Estável"
    h2 = {r.sector_id: r for r in da.sector_heatmap(gold2, as_of=AS_OF).collect()}
    assert [h2[i].alerts_24h for i in range(1, 6)] == [5, 2, 1, 0, 1]


def test_q07_job_count_constant(spark, gold):
    # one plan whatever the number of sectors: the per-sector parts are joins
    plan = da.sector_heatmap(gold, as_of=AS_OF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan


def test_q08_order(gold):
    r = al.alert_list(gold, as_of=AS_OF).collect()
    assert [x.alert_id for x in r] == [5, 6, 3, 2, 1, 4]
    assert [x.pos for x in r] == [1, 2, 3, 4, 5, 6]
    by = {x.alert_id: x for x in r}
    assert (by[1].sla_state, by[1].sla_minutes) == ("RESOLVED", 5)
    assert (by[3].sla_state, by[3].sla_minutes) == ("EXPIRED", None)
    assert (by[5].sla_state, by[5].sla_minutes) == ("RUNNING", 7)
    assert by[2].status_label == "EM ATENDIMENTO"
    assert by[3].minutes_since_fired == 25 and by[3].minutes_to_attend == 25


def test_q08_filters(gold):
    r = al.alert_list(gold, severity="CRITICO", status="", sector_id=2, as_of=AS_OF).collect()
    assert sorted(x.alert_id for x in r) == [3, 6]
    assert al.alert_list(gold, sector_id=0, as_of=AS_OF).count() == 0
    assert al.alert_list(gold, sector_id="", as_of=AS_OF).count() == 6


def test_q09_kpis(gold, gold2):
    r = al.alert_kpis(gold, as_of=AS_OF).first()
    assert (r.total_alerts, r.avg_response_min, r.avg_resolution_min, r.pct_in_sla, r.response_change_pct) == (
        6, 10.8, 45.0, 50.0, 0.0)
    assert [x.sector_name for x in al.open_critical_sectors(gold).collect()] == ["Sala de Espera - Triagem"]
    r2 = al.alert_kpis(gold2, as_of=AS_OF).first()
    assert (r2.total_alerts, r2.avg_response_min, r2.avg_resolution_min, r2.pct_in_sla) == (9, 8.8, 60.0, 55.6)


def test_q10_daily(gold):
    assert rows(al.alert_daily(gold, as_of=AS_OF), "day_label", "fired", "resolved", "fired_bar_pct") == [
        ("15/01", 6, 2, 100)]


def test_q11_window_closed_edges(gold):
    r = en.sensor_window(gold, sensor_id=1, around="2026-01-15 05:20:00", as_of=AS_OF).collect()
    assert [x.pos for x in r] == [1, 2]
    assert [x.co2 for x in r] == [900.0, 1100.0]


def test_q12_events(gold):
    got = rows(oc.occupancy_events(gold, sector_id=1).orderBy("pos"), "event_time", "change", "people", "status")
    assert got == [("11:13:00", 7, 11, "ALERTA"), ("11:12:00", -6, 4, "NORMAL"), ("11:11:00", 1, 10, "ALERTA"),
                   ("11:08:00", 3, 9, "ALERTA"), ("11:07:00", -2, 6, "NORMAL"), ("11:05:00", 1, 8, "ALERTA")]
    first = oc.occupancy_events(gold, sector_id=1).orderBy("pos").first()
    assert first.event == "Entrada Detectada (7 pessoas)" and first.occupancy_label == "11/10"
    s2 = oc.occupancy_events(gold, sector_id=2).collect()
    assert len(s2) == 1 and s2[0].event == "Sem movimentação detectada" and s2[0].occupancy_label == "12/30"


def test_q13_compliance(gold):
    got = rows(co.compliance(gold, "24h", as_of=AS_OF).orderBy("position"), "compliance_pct", "max_value")
    assert got == [(75.0, 1100.0), (100.0, 400.0), (75.0, 27.0), (75.0, 75.0), (75.0, 71.0)]
    assert {r.global_pct for r in co.compliance(gold, "24h", as_of=AS_OF).collect()} == {80.0}


def test_q14_latest_status(gold):
    r = en.latest_status(gold).collect()
    assert [(x.sensor_id, x.co2, x.status) for x in r] == [(1, 1000.0, "ATENCAO")]


def test_q15_co2_people(gold):
    assert rows(oc.co2_people_by_minute(gold, sector_id=1), "co2_avg", "people_avg") == [(800.0, 3.0)]


def test_q16_all_time(gold):
    r = al.alert_kpis(gold, window_days=None).first()
    assert (r.total_alerts, r.avg_response_min, r.pct_in_sla) == (6, 10.8, 50.0)


def test_q17_q19(gold):
    assert qa.orphan_sensors(gold).count() == 0
    r = oc.over_capacity(gold).collect()
    assert [(x.ts.strftime("%H:%M"), x.people) for x in r] == [("11:13", 11)]


def test_q18_q20(gold):
    assert rows(en.avg_co2_by_type(gold), "sector_type", "co2_avg") == [("UTI", 833.33)]
    got = {(r.table_name, r.sensor_id): r.rows for r in qa.rows_per_sensor(gold).collect()}
    assert got == {("env_readings", 1): 6, ("occupancy_readings", 3): 15, ("occupancy_readings", 6): 2}


def test_q21_lookup(gold):
    lim = {(r.sector_type, r.parameter): (r.critical_limit, r.attention_limit)
           for r in th.threshold_lookup(gold).collect()}
    assert lim[("UTI", "CO2")] == (800.0, 600.0)
    assert lim[("Farmácia", "CO2")] == (1000.0, 800.0)
    assert lim[("UTI", "VOC")] == (400.0, 250.0)
    assert lim[("Farmácia", "VOC")] == (350.0, None)
    assert lim[("UTI", "PESSOAS")] == (9999.0, 9999.0)


def test_q22_status_by_threshold(gold):
    r = th.status_by_threshold(gold).first()
    # UTI: CO2 1000 > 800 critical
    assert (r.sector_type, r.status) == ("UTI", "CRITICO")


def test_c16_null_attention_tier(spark, gold):
    from roomsense.functions import status_by_limits
    df = spark.range(1).select(
        status_by_limits(F.lit(0.0), F.lit(300.0), F.lit(1000.0), F.lit(800.0), F.lit(350.0),
                         F.lit(None).cast("double")).alias("s"))
    assert df.first().s == "NORMAL"


def test_i10_dq(gold):
    got = {(r.table_name, r.check): r.violations for r in qa.dq_report(gold).collect()}
    assert all(v == 0 for v in got.values())
    assert ("env_readings", "unique_sensor_ts") in got


def test_i12_alerts(gold):
    a = th.alerts_from_thresholds(gold).where(F.col("reading_id") == 4).collect()
    # reading 4 in a UTI: CO2 1100 > 800, temp 26 > 24, humidity 70 > 60, noise 70 > 55,
    # VOC 300 > 250 (UTI has no VOC row: the general limits apply)
    assert {(x.parameter, x.severity) for x in a} == {("CO2", "CRITICO"), ("TEMPERATURA", "CRITICO"),
                                                      ("UMIDADE", "CRITICO"), ("RUIDO", "CRITICO"),
                                                      ("VOC", "ATENCAO")}


# --- empty-table cases

def test_empty_q02(blank):
    r = en.env_summary(blank, as_of=AS_OF).first()
    assert (r.co2_avg, r.voc_avg, r.reading_time, r.co2_change_pct) == (0.0, 0.0, "--", 0.0)


def test_empty_q06a(blank):
    r = en.env_score(blank).first()
    assert (r.score, r.status, r.reading_time) == (100, "NORMAL", "--")
    assert da.dashboard_summary(blank, as_of=AS_OF).first().status_display == "ESTÁVEL"


def test_empty_q09(blank):
    r = al.alert_kpis(blank, as_of=AS_OF).first()
    assert (r.total_alerts, r.avg_response_min, r.pct_in_sla, r.response_change_pct) == (0, 0.0, 0.0, 0.0)


def test_empty_q12(blank):
    assert oc.occupancy_events(blank).count() == 0


def test_empty_q13(blank):
    got = rows(co.compliance(blank, "24h", as_of=AS_OF), "compliance_pct", "max_value", "global_pct")
    assert got == [(0.0, 0.0, 0.0)] * 5


def test_q15_window(gold):
    got = rows(oc.co2_people_by_minute(gold, sector_id=1, start="2026-01-15 06:00:00", end="2026-01-15 07:01:00"),
               "co2_avg", "people_avg")
    assert got == [(800.0, 3.0)]
    assert oc.co2_people_by_minute(gold, start="2026-01-15 08:00:00").count() == 0


def test_c18_inactive_counter_still_counts(spark, gold):
    from pyspark.sql import functions as F2
    t = gold.replace(sensors=gold.sensors.withColumn("active", F2.when(F2.col("sensor_id") == 3, 0).otherwise(1)))
    assert oc.occupancy_now(t, sector_id=1).first().people == 11
    assert {r.sector_id: r.people for r in da.sector_heatmap(t, as_of=AS_OF).collect()}[1] == 11
    assert dict(rows(da.sector_directory(t), "sector_id", "sensor_count"))[1] == 1
    assert da.active_sensors(t).first().active_sensors == 5


def test_c20_noon_window_touches_eight_dates(spark, gold):
    import datetime as dt2
    from roomsense import schemas as sc
    noon = dt2.datetime(2026, 1, 15, 12, 0)
    # 08/01 13:00 .. 14/01 13:00 (the window opens 08/01 12:00) and 15/01 09:00
    fired = [noon - dt2.timedelta(days=7) + dt2.timedelta(hours=1) + dt2.timedelta(days=d) for d in range(7)]
    fired.append(dt2.datetime(2026, 1, 15, 9, 0))
    alerts = spark.createDataFrame(
        [(i, 1, 1, "CO2", 1.0, 1.0, "ppm", "ATENCAO", "RESOLVIDO" if i % 2 else "ABERTO", f, None, None, None)
         for i, f in enumerate(fired) if f <= noon], sc.ALERTS)
    days = rows(al.alert_daily(gold.replace(alerts=alerts), as_of=noon), "day_label", "fired", "resolved")
    assert [d for d, _, _ in days] == ["08/01", "09/01", "10/01", "11/01", "12/01", "13/01", "14/01", "15/01"]
