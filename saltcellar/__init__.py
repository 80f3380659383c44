"""Sales, menu, customer and social analytics as Spark DataFrame operators."""

from saltcellar.session import open_session, prepare, scratch_path, settle

__all__ = ["open_session", "prepare", "scratch_path", "settle"]
