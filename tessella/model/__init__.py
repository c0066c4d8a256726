"""Network, training and prediction."""
