"""Point and field analytics as Spark DataFrame operators."""

from driftfield.model import Box, GridMeta, SchemaError
from driftfield.session import build_session, cut_lineage, scratch_path

__all__ = ["Box", "GridMeta", "SchemaError", "build_session", "cut_lineage", "scratch_path"]
