"""factgraph: a PySpark engine for code-to-data-flow knowledge graphs and training-data tables."""
