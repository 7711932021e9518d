"""phraseloom: a Spark-native phrase index and token-corpus engine.

Core packages: ``operators`` (vocabulary, corpus, suffix order, spans, n-grams, trie, sampling, reference checks,
skew-proof aggregation), ``sources`` (text and binary importers), ``functions`` (column helpers), ``plans`` (named
queries and their SQL twins) and ``streaming`` (incremental ingestion).  ``llm`` is an optional add-on that nothing in
the core imports.
"""

__version__ = "0.1.0"
