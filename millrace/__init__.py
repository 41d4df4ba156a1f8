"""Corporate-portfolio analytics as Spark DataFrame operators."""
