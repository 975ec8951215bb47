"""The ordered operators on live streams, with state kept by Structured Streaming."""
