"""Training-data operators: secret scan, chat format, set joins, token counts, PII, search, decontamination, packing, language ID."""
