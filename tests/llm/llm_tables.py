"""What the tests of the text operators share."""

FOLDER = "/root/testdata/sf0.001"


def pairs(df) -> list[tuple]:
    """(doc_id, text) of all rows."""
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
