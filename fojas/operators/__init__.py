"""DataFrame operators: lexical and vector search, fusion, filters, evaluation, answers."""
