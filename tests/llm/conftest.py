import pytest

TRICKY = [
    None, "", " \t\n", "a", "one two", "one two three four five", "one two three four five", "\x00\x1c\x85\xa0 weird spaces", "ß Σίσυφος ΟΔΟΣ İstanbul", "日本語のテキスト と emoji 😀😀",
    "it's we'll 3.14 x² ½ don't", "<|endoftext|> and </s>[INST] \\ & &amp; &lt;", "word " * 4000, "é J̌ combining ͅ marks",
]


@pytest.fixture(scope="session")
def tricky(spark):
    """Odd texts, null and repeated ids, and extra columns with names that operators use themselves."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i else None, 7, 0.5, "x") for i, t in enumerate(TRICKY)]
    rows += [(None, "null id", "en", "s0", 7, 0.5, "x"), (3, "a", "en", "s0", 7, 0.5, "x"), (3, "a", "en", "s0", 7, 0.5, "x"), (-50, "negative id two three", "fr", None, 7, 0.5, "x")]
    schema = "doc_id long, text string, lang string, source string, size long, score double, bucket string"
    return spark.createDataFrame(rows, schema).selectExpr("*", "1 as rid", "'k' as `key`", "2 as fp", "3 as _n", "4 as length", "5 as `a.b`").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(tricky):
    return tricky.limit(0)


@pytest.fixture(scope="session")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
