"""knotwork: record clustering and entity resolution expressed as Spark plans."""
