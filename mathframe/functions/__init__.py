"""Functions of expressions: the built-in ones and a registry for others."""
