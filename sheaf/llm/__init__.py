"""Training-data operators: ten corpus-scale jobs, each a module of its own."""
