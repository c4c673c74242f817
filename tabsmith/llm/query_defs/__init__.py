from tabsmith.llm.query_defs import ann, ctw, decontaminate, fim, langid, license, neardup, sharding, suffixes, tokens, toxicity, trie  # noqa: F401
