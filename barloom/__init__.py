"""barloom: bar-series, option-chain and table analytics declared as Spark plans."""
