"""Plan-shaping helpers: time windows and anchors, size-checked dimension
joins, latest-row and last-N patterns."""
