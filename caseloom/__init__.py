"""caseloom: evidence resolution and corpus preparation as Spark plans."""
