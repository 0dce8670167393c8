"""Trial balances turned into standard financial statements, as Spark DataFrame pipelines."""
