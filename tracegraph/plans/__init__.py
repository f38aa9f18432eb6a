"""Composed plans: ``trace()`` and ``TraceResult``."""
