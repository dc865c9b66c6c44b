"""Training-data operators: deduplication, tokens, secrets, toxicity, source mixing, audits of filters and sources, chat formatting.

Nothing outside this subpackage imports it; of the rest of the library it imports the shared folder's helpers only.
"""
