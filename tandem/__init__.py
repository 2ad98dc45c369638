"""Tandem: conversation-evaluation analytics on Spark DataFrames."""
