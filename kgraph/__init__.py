"""kgraph: code-and-conversation knowledge-graph analytics on PySpark DataFrames."""
