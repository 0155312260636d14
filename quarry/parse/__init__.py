"""Source parsing: one pass over a file yields symbols, function figures, imports, empty handlers and line classes."""
