"""The reports (Q01-Q22) and ingest / quality operators, one module per area."""
