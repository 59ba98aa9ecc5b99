"""Training-data operators: archives, language, toxicity, duplicates, tokens and media.

Nothing else in the library imports this subpackage.
"""
