"""folioscope: document-metadata quality analytics on Spark DataFrames."""
