"""Analytics over agent trajectories and training corpora, on Spark."""
