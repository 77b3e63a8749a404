"""fathom: vessel-track and corpus analytics as Spark DataFrame plans."""
