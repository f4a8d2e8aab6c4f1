"""Small document tables."""

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row long, digest string, hash string, score double, label string, kept boolean"


def rows(texts, lang="en"):
    """Documents of the given texts, with columns whose names the operators use inside."""
    return [(i, t, lang, "s", len(t or ""), 7, "d", "h", 0.5, "l", True) for i, t in enumerate(texts)]
