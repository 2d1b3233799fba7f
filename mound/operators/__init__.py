"""Filters, joins, aggregates, ordered operators and checks over DataFrames."""
