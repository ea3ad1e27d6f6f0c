"""Incomplete numeric data on Spark: cells, masks, imputation, scores, reports."""
