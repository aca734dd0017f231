"""Training-data operators and their registered queries.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
