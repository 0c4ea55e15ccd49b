"""Process, laboratory and experimental data analysis on Spark DataFrames."""
