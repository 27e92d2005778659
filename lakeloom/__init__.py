"""lakeloom: a DataFrame-first analytics engine for crawled web corpora."""

__version__ = "0.1.0"
