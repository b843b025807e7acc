"""Record-file, keyed-dataset and embedded-SQL processing as Spark plans."""

__version__ = "0.1.0"
