"""fitloom: a Spark-first engine that matches job descriptions with résumés."""
