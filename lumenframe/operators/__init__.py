"""DataFrame operators: statistics, dataset preparation, graphs, layered systems, relations and training."""
