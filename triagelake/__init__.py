"""triagelake: findings analytics and corpus processing as Spark DataFrame operators."""
