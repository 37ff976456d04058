"""Shop search, merchandising and shopper analytics as Spark jobs over tables."""
