"""netsets: weighted-network clustering and set evaluation on PySpark."""
