"""paceforge: training-load analytics expressed as Spark DataFrame plans."""
