"""Fleet-scale log scanning and alert classification on Spark DataFrames."""
