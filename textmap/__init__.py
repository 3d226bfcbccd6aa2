"""textmap: explore large text collections on Spark as topic maps."""
