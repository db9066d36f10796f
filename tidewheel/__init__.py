"""Panel analytics on Spark DataFrames: daily panels, calendar windows, quality rules, evaluation."""
