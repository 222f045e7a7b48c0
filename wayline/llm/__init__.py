"""Training-data operators: each module holds one operator and the jobs it needs."""
