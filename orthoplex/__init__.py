"""orthoplex: a semantic-layer analytics engine expressed as Spark DataFrames."""
