"""Credit-scoring analytics over tables of wallets, and corpus preparation, on Spark."""
