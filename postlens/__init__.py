"""postlens: social-post analytics as lazy Spark DataFrame operators."""
