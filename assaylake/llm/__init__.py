"""Operators for preparing training text: near copies, secrets, toxicity, packing, token counts, quality, language, sharding, personal data, benchmark leaks."""
