"""Structured Streaming: replay source, stateful online features, ensemble
scoring, de-duplicated alerts, windowed alert counts (T1-T9, S8, S9, K5)."""
