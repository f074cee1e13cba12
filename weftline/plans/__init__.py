"""The pattern language and its compilation to DataFrame plans."""
