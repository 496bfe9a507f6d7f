"""lodestrata: a Spark-first engine for transcript refinement analytics and corpus preparation."""
