"""Plans: chains of operators from the tables to a result."""
