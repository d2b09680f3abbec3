"""tillbook: point-of-sale analytics as Spark DataFrame operators and reports."""
