"""Credit-portfolio analytics and corpus operators as Spark DataFrame jobs."""
