"""Independent SQL for the registered queries, for the correctness check only."""
