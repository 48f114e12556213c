import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """make(texts, ...) → documents; ids count up unless given."""

    def make(texts, ids=None, langs=None, sources=None, **extra):
        n = len(texts)
        ids = list(range(n)) if ids is None else ids
        rows = [(ids[k], texts[k], (langs or ["en"] * n)[k], (sources or ["s"] * n)[k], None if texts[k] is None else len(texts[k]), *[v[k] for v in extra.values()]) for k in range(n)]
        schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in extra)
        return spark.createDataFrame(rows, schema)

    return make
