"""DataFrame operators: dimensions, filters, counting, graphs, citations, checks."""
