"""A PySpark-native engine for typed object graphs: search criteria and path predicates over DataFrames."""
