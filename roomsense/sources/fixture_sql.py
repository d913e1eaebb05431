"""The scale-fixture adapters as DuckDB SQL CTEs (oracle side).

Same rules as ``fixtures.build``; every oracle query in ``__spark_entry__``
starts with ``ADAPTER_CTES``.
"""

from __future__ import annotations

from roomsense.sources.fixtures import BREAKS, TWINS
from roomsense.sources.seed import THRESHOLD_ROWS
from roomsense.tables import STORAGE_NAMES


def _threshold_values() -> str:
    rows = []
    for i, (typ, param, crit, att, unit) in enumerate(THRESHOLD_ROWS, start=1):
        att_sql = "CAST(NULL AS DOUBLE)" if att is None else f"CAST({att} AS DOUBLE)"
        rows.append(f"({i}, '{typ}', '{param}', CAST({crit} AS DOUBLE), {att_sql}, '{unit}')")
    return ",\n    ".join(rows)


_N = "(SELECT n FROM n_sup)"
_V = "CAST(round(value * 100) AS BIGINT)"
_FIRED = "(o_orderkey * 7919) % 2592000"

ADAPTER_CTES = f"""
WITH n_sup AS (SELECT count(*) AS n FROM supplier),
sectors AS (
  SELECT s_suppkey + 1 AS sector_id, s_name AS sector_name,
    CASE s_suppkey % 5 WHEN 0 THEN 'UTI' WHEN 1 THEN 'Recepção' WHEN 2 THEN 'Enfermaria'
                       WHEN 3 THEN 'Cirurgia' ELSE 'Farmácia' END AS sector_type,
    CAST(s_nationkey AS VARCHAR) AS floor,
    CAST(CASE WHEN s_suppkey % 10 = 4 THEN NULL ELSE 8 + s_suppkey % 23 END AS INTEGER) AS max_capacity,
    CAST(CASE WHEN s_suppkey % 10 = 9 THEN 0 ELSE 1 END AS INTEGER) AS active
  FROM supplier),
sensors AS (
  SELECT 2 * s_suppkey + 1 AS sensor_id, 'MS-' || CAST(s_suppkey AS VARCHAR) AS sensor_code,
         'MULTISENSOR' AS sensor_type, s_suppkey + 1 AS sector_id,
         TIMESTAMP '2023-12-01 00:00:00' AS installed_at, CAST(1 AS INTEGER) AS active
  FROM supplier
  UNION ALL
  SELECT 2 * s_suppkey + 2, 'HPD2-' || CAST(s_suppkey AS VARCHAR), 'HPD2',
         CASE WHEN s_suppkey % 10 = 7 THEN s_suppkey + 1000001 ELSE s_suppkey + 1 END,
         TIMESTAMP '2023-12-01 00:00:00', CAST(CASE WHEN s_suppkey % 10 = 6 THEN 0 ELSE 1 END AS INTEGER)
  FROM supplier WHERE s_suppkey % 10 <> 8
  UNION ALL
  SELECT 10000000 + s_suppkey, 'HPD2B-' || CAST(s_suppkey AS VARCHAR), 'HPD2', s_suppkey + 1,
         TIMESTAMP '2023-12-01 00:00:00', CAST(1 AS INTEGER)
  FROM supplier WHERE s_suppkey % 10 = 5),
env_readings AS (
  SELECT event_id AS id, date_trunc('second', ts) AS ts,
         2 * (user_id % {_N}) + 1 AS sensor_id, CAST(60 AS INTEGER) AS delta_s,
         CAST(300.0 AS DOUBLE) AS luminosity,
         CAST(25.0 AS DOUBLE) + CAST(json_extract_string(props, '$.k') AS DOUBLE) / CAST(2.0 AS DOUBLE) AS humidity,
         CAST(16.0 AS DOUBLE) + (event_id % 97) / CAST(8.0 AS DOUBLE) AS temperature,
         {_V} / CAST(32.0 AS DOUBLE) AS voc,
         CAST(400.0 AS DOUBLE) + {_V} / CAST(16.0 AS DOUBLE) AS co2,
         CAST(1013.0 AS DOUBLE) AS pressure,
         CAST(35.0 AS DOUBLE) + CAST(event_id % 41 AS DOUBLE) AS noise,
         CAST(0 AS INTEGER) AS aerosol_still, CAST(0 AS INTEGER) AS aerosol_risk,
         CAST(10.0 AS DOUBLE) AS dew_point
  FROM events),
occupancy_readings AS (
  SELECT event_id AS id, date_trunc('second', ts) AS ts,
         2 * (user_id % {_N}) + 2 AS sensor_id, CAST(60 AS INTEGER) AS delta_s,
         CAST(CASE WHEN (user_id % {_N}) % 10 = 3 THEN 5 ELSE (event_id * 7) % 31 END AS INTEGER) AS people,
         CAST(300.0 AS DOUBLE) AS luminosity, CAST(50.0 AS DOUBLE) AS humidity,
         CAST(22.0 AS DOUBLE) AS temperature
  FROM events),
thresholds AS (
  SELECT * FROM (VALUES
    {_threshold_values()}
  ) AS t(threshold_id, sector_type, parameter, critical_limit, attention_limit, unit)),
alerts AS (
  SELECT o_orderkey AS alert_id,
    2 * (o_custkey % {_N}) + 1 AS sensor_id,
    o_custkey % {_N} + 1 AS sector_id,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CO2' WHEN '2' THEN 'VOC' WHEN '3' THEN 'TEMPERATURA'
         WHEN '4' THEN 'RUIDO' ELSE 'UMIDADE' END AS parameter,
    o_totalprice / CAST(1000.0 AS DOUBLE) AS measured, CAST(250.0 AS DOUBLE) AS limit_ref,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'ppm' WHEN '2' THEN 'ppb' WHEN '3' THEN '°C'
         WHEN '4' THEN 'dB' ELSE '%' END AS unit,
    CASE WHEN o_totalprice >= 250000 THEN 'CRITICO' ELSE 'ATENCAO' END AS severity,
    CASE o_orderstatus WHEN 'O' THEN 'ABERTO' WHEN 'P' THEN 'EM_ATENDIMENTO' ELSE 'RESOLVIDO' END AS status,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds({_FIRED}) AS fired_at,
    CASE WHEN o_orderstatus = 'O' THEN NULL
         ELSE TIMESTAMP '2024-01-01 00:00:00' + to_seconds({_FIRED} + o_orderkey % 1800) END AS attended_at,
    CASE WHEN o_orderstatus = 'F'
         THEN TIMESTAMP '2024-01-01 00:00:00' + to_seconds({_FIRED} + o_orderkey % 1800 + 60 * (o_orderkey % 120))
    END AS normalised_at,
    'alerta ' || CAST(o_orderkey AS VARCHAR) AS description
  FROM orders)
"""

AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
ANCHOR_SQL = f"COALESCE((SELECT max(ts) FROM env_readings), {AS_OF_SQL})"


def with_fixture(body: str) -> str:
    """``body`` either starts with ', name AS (...)' (more CTEs) or 'SELECT'."""
    return ADAPTER_CTES + body


def broken_ctes() -> str:
    """``fixtures.broken`` as CTEs named ``broken_<table>``."""
    out = []
    for table in dict.fromkeys(b[0] for b in BREAKS):
        name, source = STORAGE_NAMES[table], STORAGE_NAMES[table]
        for t, key, m, r, add in TWINS:
            if t == table:
                source = f"(SELECT * FROM {name} UNION ALL SELECT * REPLACE ({key} + {add} AS {key}) FROM {name} WHERE {key} % {m} = {r})"
        columns: dict[str, list[str]] = {}
        for t, key, m, r, column, value in BREAKS:
            if t == table:
                text = "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value)
                columns.setdefault(column, []).append(f"WHEN {key} % {m} = {r} THEN {text}")
        put = ", ".join(f"CASE {' '.join(reversed(cases))} ELSE {c} END AS {c}" for c, cases in columns.items())
        out.append(f"broken_{name} AS (SELECT * REPLACE ({put}) FROM {source})")
    return ",\n" + ",\n".join(out)
