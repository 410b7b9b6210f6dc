from .test_jaccard import stage


def text(k):
    return " ".join(f"t{k}x{i}" for i in range(40))


def test_rows_without_id_and_unlike_texts_of_one_id_stay(spark):
    rows = [
        (None, text(0), "en", "s", 1),
        (None, text(1), "en", "s", 1),
        (None, text(2), "en", "s", 1),
        (5, text(2), "en", "s", 1),
        (7, text(3), "en", "s", 1),
        (7, text(4), "en", "s", 1),
        (7, text(4), "en", "s", 1),
        (3, text(4) + " end", "en", "s", 1),
        (8, text(3), "en", "s", 1),
        (3, text(5), "en", "s", 1),
    ]
    got = sorted(((r["doc_id"], r["text"]) for r in stage(spark, rows)), key=str)
    want = [(None, text(0)), (None, text(1)), (5, text(2)), (7, text(3)), (3, text(4) + " end"), (3, text(5))]
    assert got == sorted(want, key=str)
