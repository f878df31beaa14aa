"""Program-analysis and corpus analytics expressed as PySpark DataFrame plans."""
