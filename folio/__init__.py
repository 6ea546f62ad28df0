"""folio: literature and corpus analytics as Spark DataFrame plans."""
