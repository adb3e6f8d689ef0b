"""DataFrame operators: shaping, scores, windows, data quality, upserts, metrics."""
