"""hueweave: colored sequence-graph analytics and corpus operators on Spark."""

__version__ = "0.1.0"
