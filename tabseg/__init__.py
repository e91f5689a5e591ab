"""tabseg: segmentation of mixed numeric and categorical tables, expressed as Spark plans."""

__version__ = "0.1.0"
