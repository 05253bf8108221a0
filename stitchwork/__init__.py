"""stitchwork: Spark-native curation, label-quality and scoring operators.

Every operator is a function ``DataFrame -> DataFrame`` (or a Column
expression); jobs compose them, and Catalyst plans the whole.
"""

from stitchwork.session import get_session

__all__ = ["get_session"]
