"""fathom: text retrieval, time-series quality and schema analytics as Spark DataFrame plans."""
