"""Queries by name; importing this package registers them all."""

from . import candidates, changes, corpus, documents, links, matching, phrases, questions, records, relations, rules, serving, temporal, trees, wording  # noqa: F401
