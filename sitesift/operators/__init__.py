"""DataFrame -> DataFrame operators (joins, aggregates, windows, folds)."""
