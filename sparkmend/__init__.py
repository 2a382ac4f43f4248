"""sparkmend: data health, repair and feature engine on Spark."""

__version__ = "0.1.0"
