"""Plans shared by many operators: ordered scans over long histories, exact quantiles."""
