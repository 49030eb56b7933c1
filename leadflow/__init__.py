"""Lead-management and corpus jobs written as plain functions from DataFrames to DataFrames."""
