import pytest

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, held_id string, copy int, keep_id int, mix_id int, "
    "found_spans string, language_guess string, score double, words string"
)
LONG = "the long text goes on and on with number 4111 1111 1111 1111 in it . " * 4000
TEXTS = [
    None,
    "",
    " \t\n ",
    "?! 12 34",
    "one",
    "The quick brown fox jumps over the lazy dog near the old river bank today",
    "The quick brown fox jumps over the lazy dog near the old river bank today",
    "Mail ann@example.org or call +1 (555) 010-9999, host 10.0.0.255, not 10.0.0.256. Card 4111-1111-1111-1111.",
    "Released under the MIT License. See the Apache  License and the GNU General Public license; mit license",
    "x@y a@b.c%d@e.f 1.2.3.4.5.6.7.8 +12345678 +123456789 4111111111111112 0000 0000 0000 0000",
    "a b c d e a b c d e a b c d e\nline of words\nline of words\n\r\n \nline of words",
    "naïve Ünïcode 𝒳 字 text   with spaces ÄÖ 𝒳@example.com",
    "9" * 60_000,
    "w " * 30_000,
    "a@" * 20_000,
    LONG,
]


@pytest.fixture(scope="session")
def texts():
    return TEXTS


@pytest.fixture(scope="session")
def docs(spark):
    """Null, empty, odd and long texts, a row given twice, null ids, and columns with taken names."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, 1) for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, TEXTS[5], None, None, None), (None, None, None, None, None), (None, "lost words here", "en", "s0", 1)]
    return spark.createDataFrame([(*r, "h", 7, 7, 7, "f", "g", 0.5, "w") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
