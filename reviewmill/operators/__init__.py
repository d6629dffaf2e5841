"""The jobs: plain functions from DataFrames to DataFrames."""
