"""Business rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "CRITICAL", "ATTENTION", "NORMAL", "status_fixed", "status_by_limits", "env_score", "pct_change",
    "occupancy_pct", "occupancy_band", "event_text", "occupancy_label", "sla_state", "sla_minutes",
    "trend", "alert_trend", "severity_label", "status_label", "short_description", "status_text",
    "tile_text", "status_display", "SLA_MINUTES", "NO_MOVEMENT_TEXT", "ENTRY_TEXT", "EXIT_TEXT",
]

# Status words, the fixed CO2/VOC limits of the dashboard
# status (critical 1000 ppm / 400 ppb, attention 800 ppm / 250 ppb) and the
# 15-minute response SLA.
CRITICAL, ATTENTION, NORMAL = "CRITICO", "ATENCAO", "NORMAL"
CO2_CRITICAL, CO2_ATTENTION = 1000.0, 800.0
VOC_CRITICAL, VOC_ATTENTION = 400.0, 250.0
SLA_MINUTES = 15


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def status_by_limits(co2, voc, co2_crit, co2_att, voc_crit, voc_att) -> Column:
    """Strict '>' on either parameter; a NULL limit means that tier is absent
    (NULL comparisons fall through the CASE, C16)."""
    co2, voc = _c(co2), _c(voc)
    return (F.when((co2 > _c(co2_crit)) | (voc > _c(voc_crit)), F.lit(CRITICAL))
            .when((co2 > _c(co2_att)) | (voc > _c(voc_att)), F.lit(ATTENTION))
            .otherwise(F.lit(NORMAL)))


def status_fixed(co2, voc) -> Column:
    """Status from CO2/VOC with the fixed dashboard limits."""
    return status_by_limits(co2, voc, F.lit(CO2_CRITICAL), F.lit(CO2_ATTENTION),
                            F.lit(VOC_CRITICAL), F.lit(VOC_ATTENTION))


def env_score(co2, voc) -> Column:
    """round(50*max(0, 1-co2/1000) + 50*max(0, 1-voc/400)), 0..100."""
    s = (F.lit(50.0) * F.greatest(F.lit(0.0), F.lit(1.0) - _c(co2) / F.lit(CO2_CRITICAL))
         + F.lit(50.0) * F.greatest(F.lit(0.0), F.lit(1.0) - _c(voc) / F.lit(VOC_CRITICAL)))
    return F.round(s, 0).cast("int")


def pct_change(current, previous, digits: int = 1) -> Column:
    """0 when the base is NULL or 0, else ((v - p) / p * 100) to `digits`."""
    cur, prev = _c(current), _c(previous)
    change = (F.coalesce(cur, F.lit(0.0)) - prev) / prev * F.lit(100.0)
    return F.when(prev.isNull() | (prev == 0), F.lit(0.0)).otherwise(F.round(change, digits))


def occupancy_pct(people, capacity) -> Column:
    """People / capacity * 100, one decimal; NULL when capacity is NULL or 0 (C14)."""
    return F.round(F.try_divide(_c(people).cast("double"), _c(capacity).cast("double")) * F.lit(100.0), 1)


def occupancy_band(pct) -> Column:
    """> 80 red, > 60 yellow, else green."""
    p = _c(pct)
    return F.when(p > 80, F.lit("red")).when(p > 60, F.lit("yellow")).otherwise(F.lit("green"))


# The entry/exit texts of the occupancy event table.
ENTRY_TEXT, EXIT_TEXT, NO_MOVEMENT_TEXT = "Entrada Detectada", "Saída Detectada", "Sem movimentação detectada"


def event_text(change) -> Column:
    """P07: 'Entrada Detectada (N pessoa[s])' / 'Saída Detectada (N pessoa[s])'."""
    d = _c(change)
    n = F.abs(d)
    noun = F.concat(F.lit(" pessoa"), F.when(n > 1, F.lit("s")).otherwise(F.lit("")))
    body = F.concat(F.lit(" ("), n.cast("string"), noun, F.lit(")"))
    return F.when(d > 0, F.concat(F.lit(ENTRY_TEXT), body)).otherwise(F.concat(F.lit(EXIT_TEXT), body))


def occupancy_label(people, capacity) -> Column:
    """P08: 'people/capacity' ('--' for an unknown capacity)."""
    return F.concat(_c(people).cast("string"), F.lit("/"),
                    F.coalesce(_c(capacity).cast("string"), F.lit("--")))


def sla_state(status, minutes_since) -> Column:
    """RESOLVED | EXPIRED (> 15 min since firing) | RUNNING."""
    return (F.when(_c(status) == "RESOLVIDO", F.lit("RESOLVED"))
            .when(_c(minutes_since) > SLA_MINUTES, F.lit("EXPIRED"))
            .otherwise(F.lit("RUNNING")))


def sla_minutes(status, minutes_to_attend, minutes_since) -> Column:
    """Minutes to attendance when resolved, minutes left while running."""
    return (F.when(_c(status) == "RESOLVIDO", _c(minutes_to_attend))
            .when(_c(minutes_since) > SLA_MINUTES, F.lit(None).cast("bigint"))
            .otherwise(F.lit(SLA_MINUTES) - _c(minutes_since)))


def trend(change) -> Column:
    """V04 (sensor cards): down / up / flat by the sign of a % change."""
    c = _c(change)
    return F.when(c < 0, F.lit("down")).when(c > 0, F.lit("up")).otherwise(F.lit("flat"))


def alert_trend(change) -> Column:
    """V04 (alert KPI): <= 0 is down (better), else up."""
    return F.when(_c(change) <= 0, F.lit("down")).otherwise(F.lit("up"))


# Display labels of the alert centre and the dashboard tiles.
SEVERITY_LABELS = {"CRITICO": "Crítico"}
SEVERITY_DEFAULT_LABEL = "Alerta"
STATUS_TEXT = {"NORMAL": "Normal", "ATENCAO": "Atenção", "CRITICO": "Crítico"}


def severity_label(severity) -> Column:
    """CRITICO -> 'Crítico', anything else -> 'Alerta'."""
    return F.when(_c(severity) == "CRITICO", F.lit(SEVERITY_LABELS["CRITICO"])).otherwise(
        F.lit(SEVERITY_DEFAULT_LABEL))


def status_label(status) -> Column:
    """Replace the first '_' with a space (EM_ATENDIMENTO -> 'EM ATENDIMENTO')."""
    return F.regexp_replace(_c(status), "^([^_]*)_", "$1 ")


def short_description(text, width: int = 25) -> Column:
    """First 25 characters + '...', '' when there is no text."""
    t = _c(text)
    return F.when(t.isNull() | (t == ""), F.lit("")).otherwise(
        F.concat(F.substring(t, 1, width), F.lit("...")))


def status_text(status) -> Column:
    """Tile status label, unknown -> 'Normal'."""
    s = _c(status)
    expr = F.lit(STATUS_TEXT["NORMAL"])
    for key in ("CRITICO", "ATENCAO"):
        expr = F.when(s == key, F.lit(STATUS_TEXT[key])).otherwise(expr)
    return expr


# Fixed value: the dashboard shows a NORMAL overall status as this word.
STABLE_TEXT = "ESTÁVEL"


def status_display(status) -> Column:
    """Overall status as shown on the dashboard (NORMAL -> 'ESTÁVEL')."""
    s = _c(status)
    return F.when(s == NORMAL, F.lit(STABLE_TEXT)).otherwise(s)


def tile_text(alerts_24h) -> Column:
    """V07: 'N ALERTA[S] (24h)' or 'Sistema Estável'."""
    n = _c(alerts_24h)
    return F.when(n > 0, F.concat(n.cast("string"), F.lit(" ALERTA"),
                                  F.when(n > 1, F.lit("S")).otherwise(F.lit("")), F.lit(" (24h)"))
                  ).otherwise(F.lit("Sistema Estável"))
