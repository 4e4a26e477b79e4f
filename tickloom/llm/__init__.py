"""Training-data operators: packing, fingerprints, token counts, personal data, near copies, quality, scoring, encoding, licences."""
