"""Record, lane, text, graph and search operators as DataFrame plans."""
