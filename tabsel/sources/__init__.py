"""Tables and artifacts in and out."""
