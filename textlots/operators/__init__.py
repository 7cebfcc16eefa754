"""DataFrame operators: filters, dedup, joins, aggregates, reports."""
