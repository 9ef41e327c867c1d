"""Panel time-series analytics expressed as Spark DataFrame jobs."""

from fieldseries.panel import Panel

__all__ = ["Panel"]
