"""DataFrame operators: extraction, preparation, features, models, ensembles, evaluation, selection."""
