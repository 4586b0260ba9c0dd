"""Training-data operators: quality, packing, extraction, licences, toxicity, chat, rules, leaks, counts, joins."""
