"""Small tables for the operators."""

import zlib

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOC)


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


#: Nulls, empties, white space, ties, repeated rows, a very long text.
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "same text here"), (5, "same  text\nhere"), (4, "same text here"), (None, "same text here"), (6, "long " * 30000), (None, None), (7, "päss 😀 token=abcdefgh12")]
