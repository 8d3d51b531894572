"""Operations of a training-data pipeline over ``documents``, ``pages`` and ``embeddings``.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.  ``fieldmark.llm.queries``
holds the thin ``opN_*`` queries, the other modules the operators with their own interfaces.
"""
