"""larkspur: supply-chain and corpus analytics expressed as Spark DataFrames."""
