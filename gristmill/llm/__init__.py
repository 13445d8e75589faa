"""Training-data operators (quality, toxicity, rules, packing, dedup, sharding, secrets, tokens, joins, leaks).

Nothing outside this folder imports it; ``queries`` holds what the entry file registers.
"""
