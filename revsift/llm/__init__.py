"""Operators a training-data pipeline needs: one module per operator.

Nothing outside this folder (but for the guarded lookup in ``__spark_entry__``
and ``corpus_pipeline``) imports it.
"""
