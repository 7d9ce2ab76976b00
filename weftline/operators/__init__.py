"""Relational operators: joins, aggregation, ranking, graphs and change handling."""
