"""Time-driven and stateful operators, batch and streaming."""
