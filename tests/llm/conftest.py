import pytest

#: Texts that every operator must take: null, empty, blank, one word, no letters, other scripts, long, without spaces.
ODD = [None, "", "   \n\t ", "word", "12 34 !!", "日本語のテキスト 😀", "the cat sat on the mat and the dog ran " * 4000, "x" * 200_000, "a b É Ünï"]
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts; further columns by keyword."""

    def docs(texts, ids=None, **more):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", f"s{k % 2}", len(t or "")) + tuple(v[k] for v in more.values()) for k, (i, t) in enumerate(zip(ids, texts))]
        return spark.createDataFrame(rows, DOC + "".join(f", {c} string" for c in more))

    return docs
