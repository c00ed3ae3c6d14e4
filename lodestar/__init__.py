"""lodestar: ledgers, hybrid retrieval and graph retrieval as Spark DataFrame plans."""
