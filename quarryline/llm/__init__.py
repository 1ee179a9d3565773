"""Training-data operators: one module per operator, plus `queries` with the registered queries and their SQL."""
