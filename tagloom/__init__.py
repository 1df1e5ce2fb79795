"""tagloom: multi-label tag recommendation over question corpora, as Spark DataFrame operators."""

__version__ = "0.1.0"
