"""quoteloom: market-data research operators as Spark DataFrame transformations."""
