"""Small documents with every odd case, and frames from rows."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = ("river stone light winter garden paper window silver market letter bridge forest candle mirror harbor "
         "summer copper velvet meadow lantern").split()


def prose(seed: int, words: int) -> str:
    """The same text for the same seed; different seeds share no run of five words by design of the numbers."""
    state, out = seed * 7919 + 17, []
    for _ in range(words):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[state % len(WORDS)] + str(state % 97 if state % 3 == 0 else ""))
    return " ".join(out)


def documents(spark, texts, extra: bool = False):
    """Rows in the documents' schema; pairs give the id as well. With ``extra``, columns with clashing names."""
    rows = []
    for number, item in enumerate(texts):
        key, text = item if isinstance(item, tuple) else (number, item)
        rows.append((key, text, "en", "s", len(text or "")))
    frame = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for name in ("size", "shard", "slot", "score", "id", "text_hash", "kept", "place", "word", "line", "bucket", "key", "piece", "start", "dropped",
                     "node", "total"):
            frame = frame.selectExpr("*", f"'x' AS {name}")
    return frame


ODD = [None, "", " \n\t ", "One", "one", "ONE", "É", "é", "a b c d", "a b c d", "a  b c\nd", None, "x" * 5000,
       prose(1, 3000), "<|endoftext|> it's  123 ,,, ☃ 漢字"]
