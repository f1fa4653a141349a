"""gustframe: weather-driven energy analytics and data preparation on PySpark."""
