"""quoteflow: normalize, deduplicate, land and audit market-quote feeds on Spark."""
