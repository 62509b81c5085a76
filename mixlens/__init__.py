"""A PySpark-native engine for instruction evaluation, and for training data in mixlens.llm."""
