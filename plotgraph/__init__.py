"""plotgraph: land-parcel identity, lot tracing and registry analytics as Spark DataFrames."""
