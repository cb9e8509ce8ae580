from granary.operators.relation import Order, Relation

__all__ = ["Order", "Relation"]
