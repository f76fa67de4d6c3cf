"""Page sources and chunk sinks, batch and streaming."""
