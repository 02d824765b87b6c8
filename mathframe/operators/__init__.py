"""Linear expressions and the tables that a model is made of."""
