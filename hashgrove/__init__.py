"""Identity and ad-traffic analytics as composable Spark DataFrame functions."""
