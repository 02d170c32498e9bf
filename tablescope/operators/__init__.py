"""DataFrame operators: filters, typing, profiling, cleaning, aggregation, statistics."""
