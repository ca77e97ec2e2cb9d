"""DataFrame operators: spans, text, words, plans, vectors, catalogue and evaluation."""
