"""Part of the corpus analytics engine."""
