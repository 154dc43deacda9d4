"""strandlake: k-mer analytics over long-form tables, expressed as Spark plans."""

__version__ = "0.1.0"
