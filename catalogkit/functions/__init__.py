"""Column expressions: text cleaning, extraction, language, dates, covers."""
