"""Column builders: what Catalyst can see and compile."""
