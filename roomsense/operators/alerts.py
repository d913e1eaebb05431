"""Alert reports: Q08, Q09, Q10, Q16 (+ V01, V02, V04, V09).

These use the wall clock ``as_of`` (C1).  KPIs are conditional aggregates in
one pass over the alerts; Q09 reads the current and the previous week in the
same scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomsense.functions import (SLA_MINUTES, alert_trend, ddmm, ddmm_hhmmss, minutes_between, pct_change,
                                 severity_label, short_description, sla_minutes, sla_state, status_label)
from roomsense.plans.windows import as_of_col, days, since
from roomsense.tables import Tables


def alert_list(t: Tables, severity: str | None = None, status: str | None = None, sector_id: int | None = None,
               limit: int = 50, *, as_of=None) -> DataFrame:
    """Q08: alerts with optional filters (absent/empty adds nothing, F06),
    read without regard to case like the stored codes (C10),
    inner-joined to their sector, newest ``limit`` by (fired_at, alert_id)
    descending (C6).  A global top-k: each task keeps its own top 50."""
    a = t.alerts
    if severity:
        a = a.where(F.col("severity") == F.lit(severity.strip().upper()))
    if status:
        a = a.where(F.col("status") == F.lit(status.strip().upper()))
    if sector_id is not None and sector_id != "":
        a = a.where(F.col("sector_id") == F.lit(sector_id))
    now = as_of_col(as_of)
    j = a.join(t.dim("sectors").select("sector_id", "sector_name"), "sector_id")
    top = j.orderBy(F.col("fired_at").desc(), F.col("alert_id").desc()).limit(limit)
    to_attend = minutes_between("fired_at", F.coalesce(F.col("attended_at"), now))
    since_fired = minutes_between("fired_at", now)
    # the window runs over the <= limit rows left after the top-k
    pos = F.row_number().over(Window.orderBy(F.col("fired_at").desc(), F.col("alert_id").desc()))
    out = top.select(
        pos.alias("pos"), "alert_id", "parameter", "measured", "limit_ref", "unit", "severity", "status",
        ddmm_hhmmss("fired_at").alias("fired_label"),
        to_attend.alias("minutes_to_attend"), since_fired.alias("minutes_since_fired"),
        "sector_name", "description")
    return out.select(
        "*", sla_state("status", "minutes_since_fired").alias("sla_state"),
        sla_minutes("status", "minutes_to_attend", "minutes_since_fired").alias("sla_minutes"),
        severity_label("severity").alias("severity_label"), status_label("status").alias("status_label"),
        short_description("description").alias("description_short"))


def _kpi_columns(resp, reso, cur, prev=None):
    in_sla = cur & F.col("attended_at").isNotNull() & (resp <= SLA_MINUTES)
    aggs = [
        F.count_if(cur).alias("total_alerts"),
        F.avg(F.when(cur, resp)).alias("resp"),
        F.avg(F.when(cur, reso)).alias("reso"),
        F.count_if(in_sla).alias("in_sla"),
    ]
    if prev is not None:
        aggs.append(F.avg(F.when(prev, resp)).alias("prev_resp"))
    return aggs


def alert_kpis(t: Tables, window_days: int | None = 7, *, as_of=None) -> DataFrame:
    """Q09 (window_days=7) / Q16 (window_days=None, all time): total, mean
    response and resolution minutes (NULL differences ignored), % answered
    within 15 min, and the change of mean response against the previous
    window (BETWEEN, both ends closed, C3)."""
    resp = minutes_between("fired_at", "attended_at")
    reso = minutes_between("fired_at", "normalised_at")
    if window_days is None:
        rows = t.alerts
        cur, prev = F.lit(True), None
    else:
        now = as_of_col(as_of)
        mid = now - days(window_days)
        rows = since(t.alerts, now - days(2 * window_days), ts="fired_at")
        cur = F.col("fired_at") >= mid
        prev = F.col("fired_at") <= mid
    g = rows.select("fired_at", "attended_at", "normalised_at").agg(*_kpi_columns(resp, reso, cur, prev))
    pct = F.when(F.col("total_alerts") > 0, F.col("in_sla") / F.col("total_alerts") * F.lit(100.0))
    out = [
        F.col("total_alerts"),
        F.round(F.coalesce("resp", F.lit(0.0)), 1).alias("avg_response_min"),
        F.round(F.coalesce("reso", F.lit(0.0)), 1).alias("avg_resolution_min"),
        F.round(F.coalesce(pct, F.lit(0.0)), 1).alias("pct_in_sla"),
    ]
    if prev is not None:
        change = pct_change(F.col("resp"), F.col("prev_resp"))
        out += [change.alias("response_change_pct"), alert_trend(change).alias("response_trend")]
    return g.select(*out)


def open_critical_sectors(t: Tables) -> DataFrame:
    """Q09 part: distinct names of sectors with an open critical alert (no time
    window, as in the reference)."""
    hit = t.alerts.where((F.col("severity") == "CRITICO") & (F.col("status") == "ABERTO")).select("sector_id")
    return hit.join(t.dim("sectors").select("sector_id", "sector_name"), "sector_id").select("sector_name").distinct()


def alert_daily(t: Tables, *, as_of=None, window_days: int = 7) -> DataFrame:
    """Q10: alerts fired and (of those) resolved now, per calendar day of the
    last 7 days (up to 8 dates, C20); V02 bar heights as % of the busiest
    day (floored at 1), a window over at most 8 aggregated rows."""
    now = as_of_col(as_of)
    rows = since(t.alerts, now - days(window_days), ts="fired_at")
    g = rows.groupBy(F.to_date("fired_at").alias("day")).agg(
        F.count(F.lit(1)).alias("fired"), F.count_if(F.col("status") == "RESOLVIDO").alias("resolved"))
    busiest = F.greatest(F.max("fired").over(Window.partitionBy()), F.lit(1))
    return g.select(
        "day", ddmm("day").alias("day_label"), "fired", "resolved",
        F.round(F.col("fired") / busiest * 100, 0).cast("int").alias("fired_bar_pct"),
        F.round(F.col("resolved") / busiest * 100, 0).cast("int").alias("resolved_bar_pct"),
    ).orderBy("day")
