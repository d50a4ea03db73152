"""Operators for large-scale training-data preparation (see README, "Training-data operators")."""
