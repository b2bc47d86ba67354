"""Training-data operators: one module each, their queries in ``suite``."""
