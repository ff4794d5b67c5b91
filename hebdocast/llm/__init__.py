"""Training-data operators: packing, token counts, BPE, substring dedup, quality rules,
page text, exact top-k, near-duplicates, secret scans and coded token files.

Nothing else in the library imports this package; the driver entry adds its queries only
when it is present.
"""
