"""Evaluation of model explanations, and the data work around it, as operators on Spark DataFrames."""
