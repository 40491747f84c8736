"""Training-data pipeline operators (documents, embeddings, pages).

Nothing outside this subpackage imports it; its queries live in
``casebook.llm.queries``.
"""
