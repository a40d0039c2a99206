"""From a cube definition and a query text to a resolved query: pure Python, no Spark."""
