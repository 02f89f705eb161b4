"""factline: a PySpark-native engine for evidence-backed facts about entities."""

__version__ = "0.1.0"
