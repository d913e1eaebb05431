"""Command line: run a report over a store and write it as JSON (S07), or run
the ingest stream of one feed.

    python -m roomsense report sector_heatmap --store PATH --out PATH [--as-of TS]
    python -m roomsense report env_hourly --period 7d --store PATH --out PATH
    python -m roomsense report occupancy_events --sector-id 1 --store PATH --out PATH
    python -m roomsense ingest --kind env --store PATH --landing PATH [--once]

Report names follow the reference's endpoints (see ``REPORTS``).
"""

from __future__ import annotations

import argparse
import sys

from roomsense.operators import alerts as al
from roomsense.operators import compliance as co
from roomsense.operators import dashboard as da
from roomsense.operators import environment as en
from roomsense.operators import occupancy as oc
from roomsense.operators import quality as qa
from roomsense.operators import thresholds as th

# report name -> (endpoint it answers, function(tables, args))
REPORTS = {
    "sector_directory": ("GET /api/setores", lambda t, a: da.sector_directory(t)),
    "env_summary": ("GET /api/sensores/resumo", lambda t, a: en.env_summary_trends(t, as_of=a.as_of)),
    "occupancy_now": ("GET /api/sensores/ocupacao", lambda t, a: oc.occupancy_now(t, a.sector_id)),
    "occupancy_history": ("GET /api/graficos/ocupacao", lambda t, a: oc.occupancy_history(t, a.sector_id)),
    "env_hourly": ("GET /api/graficos/ambiental", lambda t, a: en.env_hourly(t, a.period, as_of=a.as_of)),
    "dashboard_summary": ("GET /api/dashboard/resumo", lambda t, a: da.dashboard_summary(t, as_of=a.as_of)),
    "sector_heatmap": ("GET /api/dashboard/heatmap", lambda t, a: da.sector_heatmap(t, as_of=a.as_of)),
    "alert_list": ("GET /api/alertas", lambda t, a: al.alert_list(t, a.severity, a.status, a.sector_id,
                                                                  as_of=a.as_of)),
    "alert_kpis": ("GET /api/alertas/kpis", lambda t, a: al.alert_kpis(t, as_of=a.as_of)),
    "open_critical_sectors": ("GET /api/alertas/kpis (sectors)", lambda t, a: al.open_critical_sectors(t)),
    "alert_daily": ("GET /api/alertas/historico", lambda t, a: al.alert_daily(t, as_of=a.as_of)),
    "sensor_window": ("GET /api/graficos/sensor", lambda t, a: en.sensor_window(t, a.sensor_id, a.around,
                                                                               as_of=a.as_of)),
    "occupancy_events": ("GET /api/sensores/eventos", lambda t, a: oc.occupancy_events(t, a.sector_id)),
    "compliance": ("GET /api/tendencia/compliance", lambda t, a: co.compliance(t, a.period, as_of=a.as_of)),
    "latest_status": ("SQL 5.1 status per sensor", lambda t, a: en.latest_status(t)),
    "co2_people_by_minute": ("SQL 5.5 CO2 x people", lambda t, a: oc.co2_people_by_minute(t, a.sector_id, a.start, a.end)),
    "alert_kpis_all_time": ("SQL 5.7 KPIs", lambda t, a: al.alert_kpis(t, window_days=None)),
    "orphan_sensors": ("SQL test A", lambda t, a: qa.orphan_sensors(t)),
    "avg_co2_by_type": ("SQL test B", lambda t, a: en.avg_co2_by_type(t)),
    "over_capacity": ("SQL test C", lambda t, a: oc.over_capacity(t)),
    "rows_per_sensor": ("SQL counts", lambda t, a: qa.rows_per_sensor(t)),
    "dq_report": ("schema constraints", lambda t, a: qa.dq_report(t)),
    "threshold_lookup": ("getLimiar", lambda t, a: th.threshold_lookup(t)),
    "status_by_threshold": ("calcStatus", lambda t, a: th.status_by_threshold(t)),
    "env_current": ("GET /api/graficos/ambiental (current)", lambda t, a: en.env_current(t, a.period, as_of=a.as_of)),
    "co2_humidity_points": ("CO2 x humidity points", lambda t, a: en.co2_humidity_points(t, a.period, as_of=a.as_of)),
    "table_counts": ("SQL counts per table", lambda t, a: qa.table_counts(t)),
    "alerts_from_thresholds": ("alerts raised by limits", lambda t, a: th.alerts_from_thresholds(t)),
}

# reports that read the facts of ``--period`` alone: folders of earlier days are not listed
BY_PERIOD = ("env_hourly", "compliance")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m roomsense")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("report", help="run one report and write JSON lines")
    r.add_argument("name", choices=sorted(REPORTS))
    r.add_argument("--store", required=True)
    r.add_argument("--out", required=True)
    r.add_argument("--as-of", dest="as_of", default=None, help="'YYYY-MM-DD HH:MM:SS'; default now")
    r.add_argument("--period", default="24h", choices=["24h", "7d", "30d"])
    r.add_argument("--sector-id", dest="sector_id", type=int, default=None)
    r.add_argument("--sensor-id", dest="sensor_id", type=int, default=None)
    r.add_argument("--around", default=None)
    r.add_argument("--start", default=None, help="'YYYY-MM-DD HH:MM:SS', first time of co2_people_by_minute")
    r.add_argument("--end", default=None, help="'YYYY-MM-DD HH:MM:SS', last time of co2_people_by_minute")
    r.add_argument("--severity", default=None)
    r.add_argument("--status", default=None)
    i = sub.add_parser("ingest", help="run the ingest of one feed")
    i.add_argument("--kind", required=True, choices=["env", "occ"])
    i.add_argument("--store", required=True)
    i.add_argument("--landing", required=True)
    i.add_argument("--checkpoint", default=None, help="default: <spark.checkpoint.dir>/ingest_<kind>")
    i.add_argument("--initial-days", dest="initial_days", type=int, default=None)
    i.add_argument("--once", action="store_true", help="process what has landed, then stop")
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from roomsense.sources import sink
    from roomsense.streaming.ingest import IngestJob
    from roomsense.plans.windows import period_days
    from roomsense.tables import Tables, window_start

    spark = SparkSession.builder.getOrCreate()
    if args.command == "report":
        since = window_start(spark, args.store, period_days(args.period), args.as_of) if args.name in BY_PERIOD else None
        df = REPORTS[args.name][1](Tables.from_storage(spark, args.store, since), args)
        sink.write_report(df, args.out)
        return 0
    job = IngestJob(spark, args.store, args.kind, initial_days=args.initial_days)
    job.start(args.landing, checkpoint=args.checkpoint, available_now=args.once).awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())
