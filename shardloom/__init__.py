"""Tables split over many shards or databases, worked on with Spark DataFrames."""
