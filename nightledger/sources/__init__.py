"""Reading and writing of the model's tables."""
