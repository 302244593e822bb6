"""Training-data operators: tokens, chat, toxicity, fingerprints, near-duplicates, media, secrets, packing, lines, mixing.

Nothing outside this subpackage imports it.
"""
