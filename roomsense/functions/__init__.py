"""Column expressions shared by the reports: status, score, % change,
occupancy, event text, SLA, bands, time formats.  All are built-in Spark
expressions (whole-stage codegen, no Python in the data path)."""

from roomsense.functions.rules import *  # noqa: F401,F403
from roomsense.functions.timefmt import *  # noqa: F401,F403
