"""Dataset preparation for computer vision, expressed as Spark jobs."""

from framewright.model import Dataset

__all__ = ["Dataset"]
