"""Tables and layers, in and out."""
