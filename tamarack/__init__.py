"""Tamarack: text compaction, context analytics and usage statistics on Spark DataFrames."""
