"""emberway: building-scale spatial graphs and corpus operators, as Spark DataFrames."""
