"""ancestra: property-graph and record-pipeline operators as lazy Spark DataFrame plans."""
