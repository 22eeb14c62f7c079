"""Spark operators for web-privacy datasets: sites, policies, services, statements."""
