"""Operators over tables: validation, collections, folds, merges, graphs and questions about documents."""

from . import collections, folds, graph, merge, verbs, vet

__all__ = ["collections", "folds", "graph", "merge", "verbs", "vet"]
