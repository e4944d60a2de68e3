"""evigrain: ranked evidence retrieval and corpus analytics as Spark plans."""
