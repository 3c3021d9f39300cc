"""The causal operators on streams: daily counts, online classification, confirmed changes."""
