"""Work-order labelling on Spark: DataFrame operators, jobs and two user hooks."""
