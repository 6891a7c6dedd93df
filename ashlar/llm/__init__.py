"""Operators for preparing training text: archives, tokens, duplicates, mixing,
personal data, nearest neighbours, fingerprints, language-model scores, quality
and toxicity.  Nothing outside this subpackage imports it."""
