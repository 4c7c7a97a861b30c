"""Writers of graphs: JSON, HTML."""
