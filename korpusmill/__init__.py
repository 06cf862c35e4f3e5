"""korpusmill: a PySpark-native corpus engine (store, search, classify, evaluate, mill training data)."""
