"""Location-aware feature tables from rental listings, as Spark DataFrame jobs."""
