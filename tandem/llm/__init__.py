"""Training-data operators: ten corpus operators, each with a thin contract query in ``queries``."""
