"""Deductive analytics on Spark: rules, ontologies and goals compiled to DataFrames."""
