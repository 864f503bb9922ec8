"""clicktide: clickstream analytics and item recommendations on PySpark."""
