import pytest

from driftline.llm.common import ready

# Texts that break naive code: empty, blank, very long, odd characters, ties and repeats.
ODD_TEXTS = [
    None, "", " ", "\n \n", "a", "A a  a", "don't stop  \n\n now ", "x" * 50_000, "word " * 20_000,
    "ñandú él — “quoted” … ½ ² ٣ é̂", "漢字かな交じり文 テスト", "🙂🙃 emoji‍ nbsp\x85\x1c sep",
    "<|endoftext|> in <|endoftext|>text", "<\\|im_end|> \\<| <|", "tab\tsep\r\nline \t x", "don't stop  \n\n now ",
]


@pytest.fixture
def session(spark):
    return ready(spark)


@pytest.fixture
def odd_docs(session):
    """The odd texts with columns whose names clash with outputs and helpers."""
    rows = [(i if t is not None else None, t, None if i % 3 else f"s{i % 2}", i, "x") for i, t in enumerate(ODD_TEXTS)]
    return session.createDataFrame(
        rows, "doc_id long, text string, source string, n_tokens int, key string"
    )
