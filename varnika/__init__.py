"""A PySpark analytics engine for multilingual, regional-variety text corpora."""
