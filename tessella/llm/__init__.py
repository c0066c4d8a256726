"""Training-data operators: URL rules, decontamination, materialisation, dedup, quality, HTML, PII, chat, joins, packing."""
