"""quill: labelled-text preparation, DP count models, synthetic text and
perplexity reports expressed as Spark DataFrame jobs."""

__version__ = "0.1.0"
