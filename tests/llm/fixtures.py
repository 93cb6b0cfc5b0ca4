"""Small inputs with nulls, empty and long texts, ties, repeated rows and clashing columns."""

LONG = "the of and " * 4000


def documents(spark):
    """Columns ``size``, ``score``, ``kept``, ``length`` and ``component_id`` clash with results of operators."""
    rows = [
        (1, "The cat and the dog went to the old house in the wood.\nA second line that has six words.", "en", "a"),
        (2, "The cat and the dog went to the old house in the wood.\nA second line that has six words.", "en", "a"),
        (3, None, "en", "b"), (4, "", None, None), (5, " \n \t", "de", "b"), (6, "1234 !!!", "fr", "a"), (7, LONG, "en", "c"),
        (8, "Der Hund und die Katze gehen in das alte Haus mit dem Licht.", "de", None), (9, "one two", None, "c"), (10, "One\ttwo", None, "c"),
        (11, "licensed under the MIT License and under the mit license", "en", "b"), (None, "no id here at all", "en", "a"),
    ]
    full = [(*r, None if r[1] is None else len(r[1]), 1, 0.5, True, 7, 9) for r in rows]
    full.append(full[0])
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, size long, score double, kept boolean, length int, component_id long")


def empty_documents(spark):
    return documents(spark).limit(0)
