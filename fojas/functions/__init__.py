"""Column functions: text, dates, entities, vectors."""
