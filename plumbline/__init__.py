"""plumbline: SQL lineage, pipeline analytics and relational operators on Spark."""

__version__ = "0.1.0"
