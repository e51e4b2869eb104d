"""Live views of the same tables with Structured Streaming; an extension, as batches are what queries use."""
