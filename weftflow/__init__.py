"""A key/value dataflow engine on PySpark: map, route, shuffle and reduce, declared as DataFrame plans."""
