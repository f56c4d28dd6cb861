"""Read preprocessing on Spark DataFrames, with an optional text-corpus subpackage."""
