"""Labelled-text corpus preparation, splitting, modelling and scoring on Spark DataFrames."""
