"""Analytics for nanopore current signals on Spark: reads as rows of arrays, statistics, segmentation, alignment and hidden Markov models."""

__version__ = "0.1.0"
