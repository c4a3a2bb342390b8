"""lacuna: availability analytics (free gaps, ranking, reconciliation) as Spark DataFrame operators."""
