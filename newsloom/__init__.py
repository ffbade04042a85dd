"""newsloom: news coverage analytics as composable DataFrame -> DataFrame functions on Spark."""
