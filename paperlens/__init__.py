"""Analytics over a corpus of scientific papers, as PySpark DataFrame operators."""
