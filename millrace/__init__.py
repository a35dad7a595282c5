"""Millrace: web-text analytics as plain functions over Spark DataFrames."""
