"""Training-data operators: near duplicates, decontamination, licences, quality,
HTML, web archives, packing, chat formatting, exact substring removal, hard
negatives, token counts and ranked search.

Nothing else in the library imports this subpackage.
"""
