"""Speech-clip authenticity analytics as Spark DataFrame, SQL and ML jobs keyed by clip id."""
