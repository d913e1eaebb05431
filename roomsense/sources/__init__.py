"""Sources and sinks: seed data (S06), adapters from the driver's tables,
landed JSON feeds (S02-S04) and the partitioned parquet sink (S05, S07)."""
