"""Information-flow analytics and training-data operations on Spark."""
