from quillon.sources.tables import table

__all__ = ["table"]
