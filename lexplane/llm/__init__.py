"""Training-data operators: one module each, their registered queries in ``queries``."""
