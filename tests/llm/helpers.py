"""Small tables with the awkward cases every operator must take."""

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = ("the river ran past the old mill and under the bridge where children used to fish in summer while "
         "their parents sat on the bank and talked about the price of grain and the long dry weather that year ")


def docs(spark, texts, extra=None):
    """Documents with ids from 0; ``extra`` adds columns with names that operators use themselves."""
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    schema = DOCS
    for c in extra or ():
        rows = [(*r, f"keep {r[0]}") for r in rows]
        schema += f", `{c}` string"
    return spark.createDataFrame(rows, schema)


def words(text):
    return re.findall("[a-z0-9_\u0080-\U0010ffff]+", (text or "").lower())


def shingles(text, width=5):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))}


def sentence(i, n=60):
    """Prose of ``n`` words that differs from other ``i`` in every word."""
    return " ".join(f"w{i}x{k}" for k in range(n))
