import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with every awkward case: nulls, empty and long texts, repeated rows, and columns that clash with the operators' own names."""
    good = "The quick brown fox jumps over the lazy dog while a small bird sings on the old stone wall near our house."
    rows = [
        (1, good, "en", "a"), (2, good, "en", "a"), (2, good, "en", "a"), (3, None, None, None), (4, "", "en", "b"), (None, good + " Yes.", "en", "b"),
        (5, "x " * 60_000, "en", "b"), (6, "one two three four five six seven eight nine ten\n" * 3, "fr", "a"), (7, "\u00e9t\u00e9 \u3000 caf\u00e9\u2003na\u00efve #*$%&|<> \x1f tab\there", "fr", "c"),
        (8, "Licensed under CC BY-NC 4.0. All rights reserved. GNU General Public License!", "en", "c"), (9, " \n\t ", "en", "c"),
    ]
    extra = "n_words long, kept boolean, component_id string, fp string, host string, sequence_id string"
    return spark.createDataFrame([(*r, len(r[1] or ""), 7, True, "x", "y", "z", "w") for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
