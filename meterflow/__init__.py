"""meterflow: Spark jobs over archives and streams of scraped metrics."""
