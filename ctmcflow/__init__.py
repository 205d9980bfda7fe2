"""Analytics on kinetic transition networks and the data around them, as Spark jobs."""
