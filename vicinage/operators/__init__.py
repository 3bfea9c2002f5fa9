"""DataFrame operators: listings in, features, texts and verdicts out."""
