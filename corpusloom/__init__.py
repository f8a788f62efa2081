"""corpusloom: a PySpark-native analytics engine for code and documentation knowledge.

Everything is expressed as DataFrame plans that Catalyst optimises; Python runs
inside tasks only where a computation is inherently sequential.
"""
