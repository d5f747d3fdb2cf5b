"""Planning: queries, workloads, mechanisms and budgets. Nothing here reads data."""
