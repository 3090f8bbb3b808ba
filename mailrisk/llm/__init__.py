"""Training-data operators: formatting, language, near-duplicates, token output,
decontamination, archiving, packing and text classifiers.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries
only when it can be imported.
"""
