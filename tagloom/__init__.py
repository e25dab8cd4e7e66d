"""tagloom: a PySpark-native engine for named-entity-recognition datasets and their evaluation.

Everything is a function from DataFrame to DataFrame; no module keeps a session of its own.
"""

__version__ = "0.1.0"
