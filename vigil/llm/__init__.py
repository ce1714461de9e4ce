"""Training-data operators: the dealt large-corpus components.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it. The named
queries are registered in ``queries.py``; ``__spark_entry__.py`` adds them
when the subpackage is present.
"""
