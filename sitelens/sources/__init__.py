"""Readers and writers. Each reader is a Spark scan followed by a parser on DataFrames."""
