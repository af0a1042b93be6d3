"""Documents of a table as plain pairs."""


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def with_low_id(docs):
    """For the plain versions: a missing id is the smallest."""
    return [(-(2**63) if i is None else i, t) for i, t in docs]
